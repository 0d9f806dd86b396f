"""Encoding, counts, personal data, licenses and decontamination against brute force."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from buildloom.llm import bpe, decontam, licenses, pii, token_counts
from buildloom.llm.queries import tokenizer

BPE, PIECES = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
ODD = ["a<|endoftext|>b  \n\n c", None, "", " ", "naïve 漢字 🙂 it's 12345 \u0085x" * 40, "x" * 5000, "THE the\tThe", "\x00\x1f weird"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@given(text=st.text(max_size=60))
def test_merges_match_the_library(text):
    from tokenizers import Tokenizer

    ref = test_merges_match_the_library.__dict__.setdefault("ref", Tokenizer.from_file(BPE))
    v = bpe.vocabulary(BPE)
    ids = [i for p in v.pretokens(text) for i in ([v.special[p]] if p in v.special else v.merge(p.encode()))]
    assert ids == ref.encode(text, add_special_tokens=False).ids


@given(words=st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), min_size=1, max_size=3), max_size=30), other=st.lists(st.binary(min_size=1, max_size=6), max_size=10))
def test_lexicon_holds_its_words_and_no_others(words, other):
    lex = bpe.Lexicon(bpe.compile_lexicon({w: tuple(i) for w, i in words.items()}))
    asked = [*words, *other]
    for w, at in zip(asked, lex.find(asked).tolist()):
        assert (lex.ids[lex.offsets[at] : lex.offsets[at + 1]].tolist() if at >= 0 else None) == words.get(w)


@pytest.mark.parametrize("most", [1 << 18, 4])
def test_round_trip(spark, reference, most):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(ODD)] + [(None, "again", "z")], "doc_id long, text string, decoded string")
    rows = bpe.decode(bpe.encode(docs, BPE, most=most), BPE).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        t = "again" if r.doc_id is None else ODD[r.doc_id] or ""
        want = reference.encode(t, add_special_tokens=False).ids
        assert r.ids == want and r.decoded == reference.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), BPE).count() == 0


def test_digests(spark, reference):
    docs = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs, BPE), BPE)).collect()}
    ids = ",".join(map(str, reference.encode("hello there").ids))
    assert got[1].ids_sha256 == hashlib.sha256(ids.encode()).hexdigest() and got[2].n_tokens == 0
    assert got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def greedy(word, pieces):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return 0
        word, n = word[k:], n + 1
    return n


@given(pieces=st.sets(st.text("abc▁", min_size=1, max_size=5), min_size=1, max_size=12), words=st.lists(st.text("abc▁", min_size=1, max_size=10), max_size=8))
def test_automaton_is_greedy(pieces, words):
    a = token_counts.PieceAutomaton(sorted(pieces))
    assert [a.count(w) for w in words] == [greedy(w, pieces) for w in words]


def test_token_counts(spark):
    pieces = set(token_counts.read_pieces(PIECES))
    got = {r.doc_id: r for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), PIECES).collect()}
    for i, t in enumerate(ODD):
        n = [greedy("▁" + w, pieces) for w in (t or "").split()]
        assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(n), sum(n) + n.count(0), n.count(0))


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [f"{k}:{x.start()}:{x.end()}" for k, p in FORMS.items() for x in re.finditer(p, text or "") if passes(k, x.group())]


def test_personal_data(spark):
    texts = [
        "a@b.c-d@e.f_g@h.io x+y@z.co.uk. +1 (555) 123-4567 4111-1111 1111 1111 1.2.3.4.5.6.7.8 999.1.1.1", "é🙂a.b@c-d.e 💥+49 30 1234567 x", "4111111111111111", "", None,
        "00000255.1.1.1 1234 5678 9012 3456 7890", "a%%%@b..c d@e.f@g.h", "1 " * 3000, "@.@ + +1 ++12 3456789 0", "x" * 20_000 + "@y.z", "4" * 5000,
    ]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)) + [(None, "q@r.st")], "doc_id long, text string"))
    rows = pii.digests(found).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = base("q@r.st" if r.doc_id is None else texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r
        assert set(want) <= set(r.spans.split(",")) or not want
    assert pii.digests(pii.find_pii(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_boosted_spans_are_added(spark):
    # national numbers in the same shape and place as international ones
    rows = [(i, f"call +1 ({100 + i % 900}) 555-{1000 + i} now") for i in range(400)] + [(1000, "call (168) 555-5254 now"), (1001, "code 12345678901234 end"), (1002, None)]
    rows += [(2000 + i, f"id {10**13 + i * 7919} end") for i in range(200)]
    got = {r.doc_id: r.spans for r in pii.digests(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1000] == "phone:5:19" and got[1001] == "" and got[0] == "phone:5:22"


def with_luhn(draw, n):
    """n digits whose Luhn sum is right."""
    d = [draw.randrange(10) for _ in range(n - 1)]
    return next(x for c in range(10) if luhn(x := "".join(map(str, [*d, c]))))


def test_added_spans_are_those_that_pass_and_whose_like_pass(spark):
    import random

    draw = random.Random(3)
    # what stands after `card` is real, what stands after `ref` passes by chance alone
    rows = [(i, f"my card {with_luhn(draw, 15)} is") for i in range(60)]
    rows += [(100 + i, f"see ref {draw.randrange(10**14, 10**15)} is") for i in range(200)]
    rows += [(400 + i, f"host 2001:db8:{i:x}:1:2:3:4:5 up") for i in range(30)] + [(500 + i, f"write to ann{i} [at] firm [dot] com, please") for i in range(30)]
    rows += [(600, "my card 123456789012345 is"), (601, "host 2001:db8:1 up")]
    got = {r.doc_id: r.spans for r in pii.digests(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        if i < 100:
            assert got[i] == "card:8:23", (i, t)
        elif 400 <= i < 430:
            assert got[i] == f"ip:5:{len(t) - 3}"
        elif 500 <= i < 530:
            assert got[i] == f"email:9:{t.index(',')}"
        else:
            assert got[i] == "", (i, t)


def test_thresholds_do_not_turn_on_a_number_of_cases():
    cell = lambda kind, n: {"kind": kind, "n": n, "y": n, "n_held": n, "y_held": n}
    import numpy as np

    assert all(t < 1 for t in pii.thresholds([cell(k, n) for k in range(4) for n in (1, 500)], np.full(8, 0.99)))
    assert pii.thresholds([{"kind": 2, "n": 5, "y": 0, "n_held": 100, "y_held": 10}], np.array([0.1]))[2] == 2.0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4!", 5), (2, None, 0), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    out = pii.redacted(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {1: "é <email>, <ip>!", 2: None, 3: "plain"}


def test_redaction_leaves_other_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.cd", 7, "x", 3), (1, "c@d.ef 1.2.3.4", 8, None, None), (None, "g@h.ij", 9, "y", 1)], "doc_id long, text string, __key long, found string, held int")
    out = pii.redacted(docs)
    want = [(1, "<email>", 7, "x", 3), (1, "<email> <ip>", 8, None, None), (None, "<email>", 9, "y", 1)]
    assert out.columns == docs.columns and sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    assert pii.redacted(docs.limit(0)).count() == 0


def best_windows(text, least=0.8):
    """The best window of each license over a text, by trying all."""
    from collections import Counter

    words, out = licenses._split(text), {}
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for kind, t in licenses.TEMPLATES:
        want = Counter(licenses._pairs(t))
        for i in range(len(pairs)):
            have = Counter()
            for j in range(i, min(len(pairs), i + int(1.5 * want.total()) + 1)):
                have[pairs[j]] += 1
                dice = 2 * (have & want).total() / (j - i + 1 + want.total())
                if dice >= least:
                    out[kind] = max(out.get(kind, 0.0), dice)
    return out


def test_licenses(spark):
    docs = [(1, "Text here.\nReleased under the MIT License. More."), (2, "licensed under the apache license, version 2.0"), (3, "the MIT campus"), (4, None), (5, ""), (1, "Licensed under CC BY-NC 4.0.")]
    got = sorted(tuple(r) for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(1, 0, 6, "CC-BY-NC-4.0", 1.0), (1, 2, 5, "MIT", 1.0), (2, 0, 7, "Apache-2.0", 1.0)]


def test_licenses_match_all_windows(spark):
    import random

    draw, texts = random.Random(5), []
    for _, t in licenses.TEMPLATES:
        for _ in range(3):
            w = [x for x in t.split() if draw.random() > 0.12]
            for _ in range(draw.randrange(4)):
                w[draw.randrange(len(w))] = draw.choice(["other", "license", "the", "software"])
            around = [draw.choice(["plain", "words", "of", "the", "text", "under"]) for _ in range(20)]
            texts.append(" ".join([*around[:10], *w, *around[10:]]))
    texts += [" ".join(draw.choice(["software", "the", "license", "copyright", "notice", "under", "permission"]) for _ in range(300)) for _ in range(5)]
    got = {}
    for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.license] = max(got.get(r.doc_id, {}).get(r.license, 0), r.dice)
    for i, t in enumerate(texts):
        want = best_windows(t)
        # a license may give way to one that does better at the same place; the best always stays
        assert set(got.get(i, {})) <= set(want) and all(v == pytest.approx(want[k], abs=1e-6) for k, v in got.get(i, {}).items())
        assert not want or max(got[i].values()) == pytest.approx(max(want.values()), abs=1e-6)


def test_license_texts_need_an_anchor():
    # no choice of as many bigrams as a match shares is without an anchor word
    for _, t in licenses.TEMPLATES:
        pairs = licenses._pairs(t)
        bare = [p for p in pairs if not set(p.split()) & set(licenses.ANCHORS)]
        assert len(bare) < licenses.bounds(len(pairs))[0]


def test_license_places_and_their_number(spark):
    mit = "Released under the MIT License."
    docs = [(1, f"{mit} one two three four five six seven eight nine {mit} Licensed under the Apache License, Version 2.0."), (2, "This work is licensed under the GNU Lesser General Public License, version 3.")]
    got = sorted(tuple(r) for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(1, 0, 5, "MIT", 1.0), (1, 14, 5, "MIT", 1.0), (1, 19, 7, "Apache-2.0", 1.0), (2, 0, 13, "LGPL-3.0-only", 1.0)]


def test_decontamination_recall(spark):
    import random

    draw = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("th", "er", "on", "an") for b in ("in", "ou", "re", "st") for c in ("ed", "ly", "ing", "es", "nd")]
    prose = lambda n: [draw.choice(["the", "of", "and"]) if draw.random() < 0.4 else draw.choice(words) + draw.choice(words) for _ in range(n)]
    items = [(i, prose(draw.randrange(15, 60))) for i in range(30)]
    docs, want = [], set()
    for d in range(400):
        t = prose(draw.randrange(5, 300))
        if d % 4 == 0:
            i, p = draw.choice(items)
            p = [w for w in p if draw.random() > (0.1 if d % 8 == 0 else 0.0)]
            at = draw.randrange(len(t))
            t[at:at] = p
            want.add((d, i))
        docs.append((d, " ".join(t)))
    frame = spark.createDataFrame(docs + [(900, None), (901, ""), (None, "x y")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in items] + [(99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    kept = decontam.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {d for d, _ in got} | {900, 901, None}
    assert decontam.contaminated(frame.limit(0), bench).count() == decontam.contaminated(frame, bench.limit(0)).count() == 0


def test_subsequence_share():
    import numpy as np

    item = decontam.Item(np.array([1, 2, 3, 4, 2], np.uint64), decontam.Words(np.array([1, 2, 3, 4], np.uint64), np.ones(4)))
    assert item.share([9, 1, 3, 2, 4, 2]) == (0.8, 1.0) and item.share([]) == (0.0, 0.0)


def _prose(draw, n):
    return [draw.choice(["the", "of", "and"]) if draw.random() < 0.4 else f"{draw.choice('bdfgklmnprst')}{draw.choice('aeiou')}{draw.randrange(60)}" for _ in range(n)]


def test_decontamination_finds_an_item_of_a_hot_group(spark):
    import random

    draw = random.Random(7)
    items = [(i, _prose(draw, 36)) for i in range(20)]
    hot = [*_prose(draw, 50), *items[0][1], *_prose(draw, 50)]
    docs = [(d, " ".join(hot if d % 3 == 0 else _prose(draw, 136))) for d in range(900)]
    docs += [(1000, " ".join([*_prose(draw, 70), *items[0][1], *_prose(draw, 7)]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    assert got == {(d, 0) for d in range(0, 900, 3)} | {(1000, 0)}


def test_decontamination_finds_each_of_many_items(spark):
    import random

    draw = random.Random(8)
    docs = [(d, _prose(draw, 200)) for d in range(2000)]
    bench = spark.createDataFrame([(d, " ".join(w[at : at + 36])) for d, w in docs for at in [draw.randrange(164)]], "item_id long, text string")
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, bench).collect()}
    assert got == {(d, d) for d, _ in docs}


def test_wrapped_licenses(spark):
    import textwrap

    wrap = lambda kind, k, start="": textwrap.fill([t for x, t in licenses.TEMPLATES if x == kind][k], 70, initial_indent=start, subsequent_indent=start)
    mit, bsd, gpl, apache = wrap("MIT", 3), wrap("BSD-3-Clause", 0), wrap("GPL-3.0-or-later", 0), wrap("Apache-2.0", 1, "# ")
    comment = "/*\n * Copyright (c) 2020 Someone Else and Others\n *\n" + wrap("MIT", 3, " * ") + "\n *\n * The end\n */"
    docs = [(1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit + "\n\nThe end"), (2, bsd), (3, "Name\n\n" + gpl), (4, comment), (9, "#!/bin/sh\n# Name\n" + apache + "\nset -e")]
    docs += [(5, "A first line\nReleased under the MIT License.\nLast line"), (6, "Released under the MIT License\n" + bsd), (7, "no license\nat all\n\nhere"), (8, "Released under\nthe MIT License."), (10, "as we wrote, all of it is released under the mit license and nothing else is meant by this")]
    got = {(r.doc_id, r.license) for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT"), (2, "BSD-3-Clause"), (3, "GPL-3.0-or-later"), (4, "MIT"), (5, "MIT"), (6, "MIT"), (6, "BSD-3-Clause"), (8, "MIT"), (9, "Apache-2.0"), (10, "MIT")}



def test_decontamination_in_parts_and_sums_by_groups(spark, monkeypatch):
    import random

    draw = random.Random(9)
    docs = [(d, _prose(draw, 90)) for d in range(120)]
    items = [(d, " ".join(w[20:56])) for d, w in docs[::6]]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r)[:2] for r in decontam.contaminated(frame, bench).collect())
    assert whole == [(d, d) for d, _ in items]
    parts = decontam._parts(bench, 1500)
    assert len(parts) > 2 and sum(p.count() for p in parts) == len(items)
    monkeypatch.setattr(decontam, "_parts", lambda b: parts)
    monkeypatch.setattr(decontam, "_FAN", 2)
    assert sorted(tuple(r)[:2] for r in decontam.contaminated(frame, bench).collect()) == whole
    assert {r.doc_id for r in decontam.drop_contaminated(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in whole}
