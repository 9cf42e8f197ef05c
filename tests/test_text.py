from hypothesis import given, settings
from hypothesis import strategies as st

from vellichor.functions import html
from vellichor.functions.text import normalize, wordless_share
from vellichor.functions.urls import canonical_url
from vellichor.operators.export import unified_diff

MARKUP = st.text(alphabet="ab1 *_`#->|\n\t<b/i.、あ한​ é", max_size=120)


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_normal_form_is_its_own(text):
    once = normalize(text)
    assert normalize(once) == once


def test_normalize_rules():
    assert normalize(None) is None and normalize("") == ""
    assert normalize("a\r\nb c") == "a b c"
    assert normalize("one two​") == "one two"
    assert normalize("**bold** and *it* and 2*3*4") == "bold and it and 2*3*4"
    assert normalize("`**kept**`") == "`**kept**`"
    assert normalize("```\n a\n  b\n```") == "```\n a\n  b\n```"
    assert normalize("- item\n  more\n- next") == "- item more\n- next"
    assert normalize("a\n\n\n\nb") == "a\n\nb"
    assert normalize("<b>x</b> <b>y") == "x <b>y"
    assert normalize("今日 は\n晴れ") == "今日は晴れ"
    assert wordless_share("") == 0 and wordless_share("今日") == 1


def test_canonical_url():
    assert canonical_url("HTTP://Ex.org:80?b=2&utm_x=1&a=1#f") == "http://ex.org/?a=1&b=2"
    assert canonical_url("https://[2001:DB8::1]:8443/%7Ea%2fb?flag&ref=x") == "https://[2001:db8::1]:8443/~a%2Fb?flag&ref=x"
    assert canonical_url("https://u:p@ex.org/") == "https://u:p@ex.org/"
    for bad in (None, "", "ftp://a/b", "https://", "http://a:x/", "no url"):
        assert canonical_url(bad) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc%27E/?&=+._~ #:é", max_size=30))
def test_canonical_url_idempotent(tail):
    once = canonical_url("https://Ex.org/" + tail)
    assert once is None or canonical_url(once) == once


def test_html_blocks_and_coverage():
    page = "<html><title>T &amp; U</title><nav><li>Menu</nav><main><h1>Head<p>First paragraph that is long enough to count as prose.<p>Second one, which is also long enough to count here.</main><aside>An aside that is long enough to be counted as dropped prose.</aside><script>x</script>"
    title, body = html.to_markdown(page)
    assert title == "T & U" and "Menu" not in body and body.startswith("# Head")
    m = html.measure(page, body)
    assert m["basis"] == "html-prose" and 0 < m["captured_chars"] < m["prose_chars"] and m["dropped"] == {"aside": 1}
    assert html.to_markdown(None) == (None, None) and html.measure("", "x")["basis"] == "unknown"


def test_unified_diff_marks_missing_newline():
    out = unified_diff("a\nb", "a\nc\n", "1", "2")
    assert "-b\n\\ No newline at end of file\n+c\n" in out
    assert unified_diff("x", "x", "1", "2") == ""
