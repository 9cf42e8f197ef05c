import collections
import random
import re
import unicodedata

import numpy as np
import pytest

from vellichor.llm import boilerplate, encoding, neardup, pii, pii_rules, pii_samples, residue, tagger
from vellichor.llm.bpe import DEFAULT_VOCABULARY, BytePairEncoder, PairTree

PAGE = """Home · News · Search · Login
Home > Bridges > Old bridges

# Old bridges

The first bridge was built in 1901. It stands.

Advertisement

- It has four arches.
- It was repaired twice.

| year | cost |
|---|---|
| 1901 | 12 |

```
nav | home | about
```

Share | Save | Print
## You may also like
Notes on a ferry
The quiet harbour
© 2020 Bridges Online. All rights reserved."""


def brute_bpe(encoder, word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        ranks = [encoder.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        if min(ranks) == 1 << 60:
            break
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [encoder.ranks[p] for p in parts]


@pytest.fixture(scope="module")
def encoder():
    return BytePairEncoder(DEFAULT_VOCABULARY)


def test_bpe_equals_brute_force_and_library(encoder):
    rng = random.Random(1)
    for _ in range(300):
        word = bytes(rng.choice(b"abcdefthe ing\xe3\x81\x82\xed\x95\x9c") for _ in range(rng.randrange(1, 40)))
        assert encoder.merge(word) == brute_bpe(encoder, word)
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    library.encode_special_tokens = True
    for text in ("", " ", "a  b \n c ", "it's  'll x", "日本語の長い文" * 300, "한국어 문장 " * 50, "x" * 20_000, "<|endoftext|>", "\n\n  x　y "):
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(None) == [] and encoder.count("a b") == len(encoder.encode("a b"))


def test_pair_tree_is_leftmost_minimum():
    tree = PairTree([5, 3, 9, 3])
    assert tree.best() == 1
    tree.put(1, 1 << 62)
    assert tree.best() == 3
    assert PairTree([1 << 62]).best() == -1


def test_furniture_lines_and_rendering():
    rules = boilerplate.Visibility()
    lines = PAGE.split("\n")
    found = {lines[i] for i in boilerplate.furniture_lines(PAGE, rules)}
    assert found == {
        "Home · News · Search · Login", "Home > Bridges > Old bridges", "Advertisement", "Share | Save | Print", "## You may also like",
        "Notes on a ferry", "The quiet harbour", "© 2020 Bridges Online. All rights reserved.",
    }
    out = boilerplate.render(PAGE)
    assert out.startswith("# Old bridges\n\nThe first bridge") and "| 1901 | 12   |" in out and "nav | home" in out
    assert boilerplate.furniture_lines("", rules) == [] and boilerplate.render("\n \n") == ""
    assert boilerplate.furniture_lines("<nav>\na\nb", rules) == [0, 1, 2]


def test_residue_model_separates_passages():
    errors = ["Page not found\n\nSorry, we can’t find the page you were looking for.", "Access denied\n\nYou don’t have permission to view this page.", "Your text goes here.", "Dear {{ name }}, welcome to the club."] * 6
    rng = random.Random(2)
    nouns = "bridge ferry harbour council archive ledger orchard mill".split()
    pages = [" ".join(f"The {rng.choice(nouns)} of {rng.choice(nouns)} was repaired in {rng.randrange(1900, 2000)}." for _ in range(8)) for _ in range(60)]
    scorer = residue.ResidueScorer(residue.fit_bodies(errors + pages))
    assert scorer.is_residue("Access denied\n\nYou don’t have permission to see the mill.")
    assert scorer.is_residue(pages[0] + "\n\nDear {{ user.name }}, the mill is open.")
    assert not scorer.is_residue(pages[1]) and not scorer.is_residue(None) and not scorer.is_residue(" \n ")
    assert not scorer.is_residue(pages[2] + "\n\nWrite `{{ name }}` there.\n\n```\n{{ title }}\n```")
    assert not scorer.is_residue(pages[3] + "\n\nPage not found, says a sign on the bridge.")
    assert residue.fit_bodies([]).score({"x"}) < 0


def test_misread_text_is_found_and_regained():
    rng = random.Random(4)
    words = "Brücke über Straße Häuser Grün naïve café “alt” — schön größer l’été où déjà".split()
    clean = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(400)] + ["전체 기록 가운데 문서 " * 3, "記録を比較した庭園" * 2] * 60
    pairs, chars = np.zeros(1 << encoding.PAIR_BITS), np.zeros(1 << encoding.CHAR_BITS)
    for text in clean:
        c = encoding.codes(text)
        wide = encoding._wide(c)
        np.add.at(pairs, encoding.buckets(c)[wide], 1)
        np.add.at(chars, np.concatenate((c[:-1][wide], c[1:][wide])) & 0xFFFF, 1)
    worker = encoding.Ungarbler(encoding.PairModel(pairs, chars))
    text = "Häuser über Grün — café"
    for wrong in ("cp1252", "mac_roman", "cp437"):
        garbled = text.encode().decode(wrong)
        assert worker.is_garbled(garbled) and worker.repaired(garbled) == text
    korean = "전체 기록 가운데"
    assert worker.repaired(korean.encode("cp949").decode("latin_1")) == korean
    for fine in (text, korean, "", None, "plain", "samples `Ã©` and `â€™` here", "Über ÄÖÜ", "```\nÃ©\n```"):
        assert not worker.is_garbled(fine)
    assert worker.is_garbled("H�user") and worker.repaired("H�user") == "H�user"


def test_neardup_parts():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdef gh\t\n") for _ in range(1500))
    plain = lambda t: " ".join(x for x in re.split(r"[ \t\r\n]+", t) if x)
    batch = neardup.Batch([" \n", text, "short", "", "\t" + text[:40] + " \r\n", "exactly8"])
    assert batch.which.tolist() == [1, 4, 5]
    for start, n, want in zip(batch.starts, batch.lengths, (plain(text), plain(text[:40]), "exactly8")):
        assert "".join(map(chr, batch.codes[start : start + n])) == want
    edited = text[:700] + "XY" + text[700:]
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in map(plain, (text, edited))]
    ha, hb = neardup.shingle_set(text), neardup.shingle_set(edited)
    assert len(ha) == len(sets[0]) and neardup.overlap(ha, hb) == len(sets[0] & sets[1])
    assert neardup.overlap(ha, hb, len(sets[0]) + 1) == 0
    values = np.sort(rng.choices(range(1 << 22), k=300)).astype(np.uint32)
    assert (neardup.unpack(neardup.pack(values)) == values).all()


def test_neardup_block_in_rows_loses_no_pair():
    rng = np.random.default_rng(5)
    table = rng.integers(0, 40, 1 << neardup.BUCKET_BITS).astype(np.uint8)
    bodies = []
    for _ in range(40):
        base = rng.choice(20000, int(rng.integers(60, 400)), replace=False)
        for share in (0.0, 0.1, 0.2, 0.24, 0.3):
            own = base.copy()
            some = rng.choice(len(base), int(share * len(base)), replace=False)
            own[some] = rng.integers(0, 20000, len(some))
            bodies.append(np.sort(own[: max(50, int(rng.integers(len(own) * 3 // 4, len(own) + 1)))]).astype(np.uint32))
    bodies.append(np.repeat(bodies[0], 2))  # a list may hold a body more than once
    assert all((a == b).all() for a, b in zip(np.split(*(lambda v, at: (v, at[1:-1]))(*neardup.unpack_all([neardup.pack(b) for b in bodies]))), bodies))

    def lists(i, need):
        return neardup.pack(bodies[i][neardup._places(bodies[i], table) < len(bodies[i]) - need + neardup._extra(len(bodies[i]))])

    def block(which):
        rows, packed = {}, bytearray()
        for i in which:
            part = lists(i, int(np.ceil(0.6 * len(bodies[i]) - 1e-9)))
            rows[i] = (len(bodies[i]), len(packed), len(packed) + len(part))
            packed += part
        found = neardup._Block(rows, packed, table, 0.6)
        assert not packed
        return found

    def shared(x, y):
        return sum((collections.Counter(bodies[x].tolist()) & collections.Counter(bodies[y].tolist())).values())

    order = sorted(range(len(bodies)), key=lambda i: (len(bodies[i]), i))
    true = {(min(x, y), max(x, y)) for k, x in enumerate(order) for y in order[k + 1 :] if shared(x, y) >= neardup._required(len(bodies[x]), len(bodies[y]), 0.6)}
    found = {(min(p), max(p)) for x, y in block(order).within() for p in zip(x.tolist(), y.tolist())}
    assert len(true) > 50 and true <= found and len(found) < len(bodies) ** 2 / 20
    small, large = order[:100], order[100:]
    probes = [(i, len(bodies[i]), lists(i, int(neardup._required(len(bodies[i]), len(bodies[i]), 0.6)))) for i in small]
    across = {(min(p), max(p)) for x, y in block(large).probed(probes) for p in zip(x.tolist(), y.tolist())}
    assert {p for p in true if len({*p} & {*small}) == 1} <= across


def test_tagger_gradients_and_viterbi():
    model = tagger.Tagger.fresh(5, 2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, tagger.ALPHABET, (7, 3)), rng.integers(0, len(tagger.TAGS), (7, 3))
    _, grads = model.gradients(x, y)
    for name, at in (("T0", (x[2, 1], 3)), ("U0", (1, 2)), ("T1", (x[4, 0], 16)), ("U1", (2, 7)), ("W", (3, 4)), ("b", (2,)), ("A", (y[0, 0], y[1, 0]))):
        keep = model.p[name][at]
        loss = []
        for step in (1e-3, -1e-3):
            model.p[name][at] = keep + step
            loss.append(model.gradients(x, y)[0])
        model.p[name][at] = keep
        assert abs((loss[0] - loss[1]) / 2e-3 - grads[name][at]) < 2e-6 + 0.02 * abs(grads[name][at]), name
    small = tagger.Tagger.fresh(5, 3)
    x = rng.integers(0, tagger.ALPHABET, (4, 6)).astype(np.uint8)
    e = small.emissions(x)
    best = small.decode(x)
    import itertools

    for col in range(3):
        score = lambda path: sum(e[t, k, col] for t, k in enumerate(path)) + sum(small.p["A"][i, j] for i, j in zip(path, path[1:]))  # noqa: B023, E731
        assert abs(score(best[:, col]) - max(map(score, itertools.product(range(len(tagger.TAGS)), repeat=4)))) < 1e-4


def test_personal_data_in_texts():
    text = "Reported by Ione M. Grelloway, 45 Weir Street, Apt 3C, Velluma 00213. Write to ione.g+x@mail.example or (415) 555-0137, ID QQ 12 34 56 C."
    (spans,) = pii.find_in_texts([text])
    assert {(text[a:b], k) for a, b, k in spans} == {
        ("Ione M. Grelloway", "person"), ("45 Weir Street, Apt 3C, Velluma 00213", "address"), ("ione.g+x@mail.example", "email"), ("(415) 555-0137", "phone"), ("QQ 12 34 56 C", "id_number"),
    }
    clean = pii.redact(text, spans)
    assert "Grelloway" not in clean and clean.startswith("Reported by [PERSON], [ADDRESS]. Write to [EMAIL]")
    assert pii.find_in_texts([None, "", "   ", "The mill opened at 12:45 in 1901, ISBN 978-0-00-967400-0."]) == [[], [], [], []]
    long = "The harbour keeps ledgers and maps. " * 4000 + "Contact: mirel@museum.test"
    ((a, b, kind),) = pii.find_in_texts([long])[0:1][0]
    assert (long[a:b], kind) == ("mirel@museum.test", "email")


def test_windows_cover_texts():
    for n in (1, 255, 256, 257, 1000, 5000):
        cover = set()
        for _, start in tagger.windows_of([n]):
            cover |= set(range(start + (tagger.OVERLAP if start else 0), min(n, start + tagger.WINDOW - (tagger.OVERLAP if start + tagger.WINDOW < n else 0))))
        assert cover == set(range(n))


def test_fold_and_rules():
    assert residue.fold("Ｐａｇｅ nоt​ found") == "Page not found"
    assert residue.fold(unicodedata.normalize("NFD", "é")) == "é"
    assert pii_rules.labels("Dr. Anaïs Ibarrondel said so.") == [(4, 20, "person")]
    assert pii_rules.labels("call 020 7946 0325 now") == [(5, 18, "phone")]


def test_names_in_cyrillic():
    text = "Ответственный: Снежана Туманцевский, адрес: ул. Речная, д. 4."
    (spans,) = pii.find_in_texts([text])
    assert ("Снежана Туманцевский", "person") in {(text[a:b], k) for a, b, k in spans}
    assert pii.settle("пишет Снежана Туманцевский.", [(6, 26, "person", 2.0)]) == [(6, 26, "person")]
    assert pii.settle("η Ελένη Παππά", [(2, 13, "person", 2.0)]) == [(2, 13, "person")]


def test_mentions_in_sentences_of_no_table():
    wanted = {
        "Maria Gonzalez can be reached at +34 912 345 678 after noon.": {("Maria Gonzalez", "person"), ("+34 912 345 678", "phone")},
        "Yesterday John Smith signed the papers.": {("John Smith", "person")},
        "Contact Anna Kowalska, PESEL 84051204567, ul. Długa 5, Kraków.": {("Anna Kowalska", "person"), ("84051204567", "id_number"), ("ul. Długa 5, Kraków", "address")},
        "The award went to Emily Carter of Leeds.": {("Emily Carter", "person")},
        "Письмо отправила Ольга Смирнова, тел. +7 912 345-67-89.": {("Ольга Смирнова", "person"), ("+7 912 345-67-89", "phone")},
        "电话199 0000 1287": {("199 0000 1287", "phone")},
    }
    for text, spans in wanted.items():
        assert {(text[a:b], kind) for a, b, kind in pii.find_in_texts([text])[0]} == spans


def test_mention_of_any_length_and_over_a_window():
    mail = "a" * 300 + "@" + "b" * 200 + ".example.org"
    for pad in range(0, 300, 37):
        text = "word " * (pad // 5) + "write to " + mail + " today, says John Smith."
        spans = {(text[a:b], kind) for a, b, kind in pii.find_in_texts([text])[0]}
        assert (mail, "email") in spans


def test_made_up_samples_are_labelled():
    rng = random.Random(77)
    right = wanted = 0
    for _ in range(300):
        text, spans = pii_samples.sample(rng)
        assert all(0 <= a < b <= len(text) for a, b, _ in spans)
        got = set(tagger.spans_of(tagger.tag_texts(tagger.Tagger.load(), [tagger.encode(text)])[0]))
        right, wanted = right + len(got & set(spans)), wanted + len(spans)
    assert right > 0.9 * wanted  # 820 of 897 when written


def test_long_notices_and_long_paragraphs():
    notice = "We use cookies to measure visits: accept all or decline. " * 8 + "All rights reserved."
    assert len(notice) > 400 and boilerplate.looks_like_furniture(notice)
    paragraph = "The mill was built beside the weir and worked until the war. " * 12 + "They use cookies to make the miller accept. " + "It then stood empty for years. " * 12
    assert not boilerplate.looks_like_furniture(paragraph)


def test_unclosed_fence_hides_nothing():
    garbled = "Le cafÃ© est fermÃ© depuis l’Ã©tÃ© dernier"
    text = "a `b` ```\nx\n``` c"
    plain = encoding._blank_code(text)
    assert len(plain) == len(text) and plain.split() == ["a", "c"] and plain.count("\n") == 2
    assert garbled in encoding._blank_code("# code\n```\nx = 1\n" + garbled)


def test_windows_without_signs_hold_no_mention(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(pii_samples.sample(rng)[0] + " and nothing else was said about the mill that day." * rng.randrange(9) for _ in range(3)) for _ in range(120)]
    found = pii.find_in_texts(texts)
    monkeypatch.setattr(pii, "signs", lambda text: [(0, len(text))])
    assert pii.find_in_texts(texts) == found and sum(map(len, found)) > 300
