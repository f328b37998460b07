"""The ten operators against brute force on small tables, and on special input."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest

from fidelis.llm import compression_classifier, decontamination, license_scan, line_dedup, lm_scoring, near_dup, quality_rules, sentencepiece, substring_dedup, warc
from fidelis.llm.text import split_words

SCHEMA = "doc_id long, text string, lang string, h string, n long, key string"
PROSE = "The river ran past the old mill and in the evening a heron was seen by the weir, as it had been for many years."


def docs(spark, rows, extra=True):
    """Rows (doc_id, text) with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", 1, "k") for i, t in rows], SCHEMA) if extra else spark.createDataFrame(rows, "doc_id long, text string")


def special(spark):
    """Null ids and texts, empty and blank texts, a repeated id, a long word and a text of one word many times."""
    return docs(spark, [(1, None), (2, ""), (3, " \t\n "), (None, "no id"), (4, "again"), (4, "Again, another text"), (5, "x" * 70_000), (6, "same " * 5000), (7, PROSE), (8, PROSE), (9, "one")])


@pytest.fixture(scope="module")
def corpus():
    """Random prose of few words, with copies, near copies and shared passages."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 160))]
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            a = rng.randint(0, 40)
            words[at:at] = passage[a : a + rng.randint(10, 20)]
        if i % 5 == 1:
            words = out[-1][1].split()
            words[rng.randrange(len(words))] = "edit"
        if i % 10 == 2:
            words = out[-1][1].split()
        out.append((i, " ".join(words)))
    return out


INNER = "t w l h s m _m _mt _mw _ml encode _encode items windows _items _windows doc th gone new _id _gone _new node sig n c key band low root set at k z own places known hot place row rows top".split()


def test_columns_with_the_names_that_operators_use_inside(spark):
    """All of them at once, in capitals too; the texts alone decide, and columns that are passed on keep their values."""
    names = [n.upper() if i % 2 else n for i, n in enumerate(INNER)]
    texts = [(1, PROSE * 4), (2, PROSE * 4), (3, "one line of five words\nand one more line of many"), (4, "one line of five words\nand one more line of many\nown")]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in texts]
    d = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    bench = spark.createDataFrame([(1, "one line of five words and one more line of many")], "item_id long, text string")
    for made in (quality_rules.keep_good(d), decontamination.clean(d, bench), line_dedup.deduplicated(d), near_dup.representatives(d, 2, 80)):
        assert made.columns == d.columns
        for r in made.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]
    import public_tokenizers

    tokens = sentencepiece.encoded(d, public_tokenizers.path("piece_bpe_32k.model"))
    assert tokens.columns[1 : 1 + len(names)] == names and tokens.count() == 4
    assert {r["doc_id"] for r in near_dup.representatives(d, 2, 80).collect()} == {1, 3, 4} - ({4} if near_dup.components(d, 2, 80).where("doc_id = 4 AND component_id = 3").count() else set())
    assert {r["doc_id"] for r in decontamination.clean(d, bench).collect()} == {1, 2}
    plain = d.select("doc_id", "text")
    for f in (near_dup.components, substring_dedup.deduplicated, lm_scoring.scored, license_scan.scanned, lambda x: compression_classifier.scored(x, compression_classifier.Model(b"", b"", (), 0.5)), lambda x: quality_rules.judge(x).select("doc_id", "kept", "failed_rules"), lambda x: warc.round_trip(x, key="doc_id", payload="text")):
        assert sorted(map(repr, f(d).collect())) == sorted(map(repr, f(plain).collect()))


# --- 1


def test_quality_rules_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = {r[0]: r[1:] for r in c.execute(quality_rules.op1_sql()).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in quality_rules.op1_quality_rules(spark, data).collect()}
    assert got == want


def test_quality_rules_special(spark):
    r = quality_rules.judge(special(spark)).collect()
    assert len(r) == 11 and all(x["base_failed"] and not x["kept"] for x in r if x["doc_id"] in (1, 2, 3, 5, 6, 9))
    six = next(x for x in r if x["doc_id"] == 6)
    assert (six["_m"]["n_words"], six["_m"]["n_repeat_words"]) == (5000, 5000)
    assert quality_rules.keep_good(special(spark)).columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_quality_rules_keep_prose(spark):
    rng = random.Random(9)
    text = PROSE + "\n" + " ".join(rng.choice(["the", "of", "mill", "boat", "grey", "stone", "a", "and", "lantern", "walked", "under", "bridge"]) for _ in range(60)) + "."
    assert quality_rules.keep_good(docs(spark, [(1, text), (2, text.replace(" ", "### "))])).count() == 1


# --- 2


def test_licence_sequences():
    full = " ".join(license_scan.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"))
    assert license_scan.licences(license_scan.identifiers("Text before.\n" + full)) == ["BSD-3-Clause"]
    two = " ".join(license_scan.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    assert license_scan.licences(license_scan.identifiers(two + "\nReleased under the MIT  license!")) == ["BSD-2-Clause", "MIT"]
    assert license_scan.identifiers("A license is needed.") == []
    for name, text in license_scan.SENTENCES.items():
        assert license_scan.identifiers(text) == [name]


@pytest.mark.parametrize("prefix", ["", "    ", " * ", "# ", "// ", "rem ", "dnl "])
@pytest.mark.parametrize("width", [40, 70, 78])
def test_licences_wrapped(prefix, width):
    """Every known sentence and whole notices, filled to a width, alone and in comment blocks."""
    import textwrap

    fill = lambda x: textwrap.fill(x, width, initial_indent=prefix, subsequent_indent=prefix, break_on_hyphens=False, break_long_words=False)
    known = license_scan.SENTENCES
    for name, text in known.items():
        assert license_scan.identifiers("Some file.\n" + fill(text) + "\nmore words\n") == [name]
    blank = f"\n{prefix.rstrip()}\n"
    join = lambda *names: fill(" ".join(known[k] for k in names))
    mit = blank.join([fill("Copyright (c) 2020 Some One"), join("mit-grant"), join("mit-notice"), join("mit-warranty", "mit-liability")])
    assert license_scan.licences(license_scan.identifiers(mit)) == ["MIT"]
    bsd = blank.join([join("bsd-grant"), fill("1. " + known["bsd-source"]), fill("2. " + known["bsd-binary"]), fill("3. " + known["bsd-endorse"])])
    assert license_scan.licences(license_scan.identifiers(bsd)) == ["BSD-3-Clause"]
    copy, url = known["apache-copy"].rsplit(" ", 1)
    apache = blank.join([join("apache-not-except") + "\n" + fill(copy), fill(url), join("apache-as-is", "apache-limits")])
    assert license_scan.identifiers(apache) == ["apache-not-except", "apache-copy", "apache-as-is", "apache-limits"]
    gpl = blank.join([join("gpl2-free"), join("gpl-hope", "gpl-details")])
    assert license_scan.licences(license_scan.identifiers(gpl)) == ["GPL-2.0-or-later"]


def test_every_rule_finds_its_licence():
    """The sentences of each rule, one a line in a comment, between other words."""
    for ids, name in license_scan.RULES:
        text = "Some words.\n" + "\n".join(f"# {license_scan.SENTENCES[k]}" for k in ids) + "\n\nOther words.\n"
        assert license_scan.identifiers(text) == list(ids) and license_scan.licences(list(ids)) == [name]
    # A sentence between them that no rule takes is passed over; a sequence that is broken gives what its parts do.
    assert license_scan.licences(["zlib-notice", "isc-grant", "isc-warranty", "isc-liability", "spdx-Zlib"]) == ["ISC", "Zlib"]
    assert license_scan.licences(["mit-grant", "bsd-grant", "bsd-source", "bsd-binary", "mit-notice"]) == ["MIT", "BSD-2-Clause"]


def test_licences_in_a_very_long_text():
    long = "plain words without any mark " * 40_000
    assert license_scan.licences(license_scan.identifiers(f"{long}\n\nSPDX-License-Identifier: Apache-2.0\n\n{long}. {license_scan.SENTENCES['unlicense-domain']}")) == ["Apache-2.0", "Unlicense"]


def test_licences_not_across_sentences():
    assert license_scan.identifiers("Licensed under\n\nthe MIT License.") == []
    assert license_scan.identifiers("Licensed under. the MIT License.") == []
    assert license_scan.identifiers("It is licensed under the MIT License.") == []


def test_licences_special(spark):
    r = license_scan.scanned(special(spark)).collect()
    assert len(r) == 11 and all(x["licences"] == [] for x in r)


def test_licences_against_lines(spark, data):
    got = {r["doc_id"]: r["licences"] for r in license_scan.op2_license_scan(spark, data).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        assert got[r["doc_id"]] == ",".join(sorted({n for line, n in lines.items() if line in r["text"]}))


# --- 3


def test_tokens_as_the_library(spark, data):
    import public_tokenizers
    import sentencepiece as library

    path = public_tokenizers.path("piece_bpe_32k.model")
    theirs, mine = library.SentencePieceProcessor(model_file=path), sentencepiece.table(path)
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "ñ", "😀", "▁", "日本", "\x00", "0", "...", "###", "\r\n", "<s>", "<0x41>", "ﬁ", "ing"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = theirs.encode(x)
        assert mine.encode(x) == ids
        assert mine.decode(ids) == theirs.decode(ids)
    for n in range(40):
        assert mine.encode(" " * n + "x" + " " * n) == theirs.encode(" " * n + "x" + " " * n)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in sentencepiece.op3_sentencepiece(spark, data).collect():
        ids = theirs.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()


def test_pair_test_is_what_merging_does():
    import public_tokenizers

    t = sentencepiece.table(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    reachable = [i for i in t.ids.values() if t.size[i] == 1 or t.order[i] >= 0 and t.left[i] >= 0]
    for _ in range(5000):
        a, b = rng.choice(reachable), rng.choice(reachable)
        if t.pieces[b].startswith(sentencepiece.BLANK):
            continue
        assert t.compatible(a, b) == (t.merge(t.pieces[a] + t.pieces[b]) == [t.pieces[a], t.pieces[b]])


def test_tokens_special(spark):
    import public_tokenizers

    r = sentencepiece.encoded(special(spark), public_tokenizers.path("piece_bpe_32k.model"), ids=True).collect()
    assert len(r) == 11 and {x["n_tokens"] for x in r if x["doc_id"] in (1, 2)} == {0}


# --- 4


def brute_substrings(rows, n=13):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = split_words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), i) < i:
                gone[k : k + n] = [True] * n
        left = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize("pieces", [20_000, 1])
def test_substrings(spark, corpus, monkeypatch, pieces):
    monkeypatch.setattr(substring_dedup, "PIECES", pieces)  # 1: every anchor is spread over shards
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.deduplicated(docs(spark, corpus)).collect()}
    assert got == brute_substrings(corpus)
    assert sum(x[1] for x in got.values()) > 500


def test_substrings_special(spark):
    got = sorted(tuple(r) for r in substring_dedup.deduplicated(special(spark)).collect() if r["doc_id"] not in (4, None))
    brute = brute_substrings([(1, ""), (2, ""), (3, ""), (5, "x" * 70_000), (6, "same " * 5000), (7, PROSE), (8, PROSE), (9, "one")])
    assert got == sorted((i, *v) for i, v in brute.items())
    assert substring_dedup.deduplicated(special(spark)).count() == 11 and substring_dedup.deduplicated(docs(spark, [])).count() == 0


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    long = " ".join(f"w{k}" for k in range(20))
    rows = [(1, long), (2, "other words " + long), (2, "words"), (2, long + " tail"), (None, long), (None, long)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.deduplicated(docs(spark, rows)).collect())
    assert got == [(0, 20, 0), (0, 20, 0), (1, 20, 0), (2, 1, 0), (2, 21, 20), (2, 22, 20)]


def test_only_windows_that_recur_are_confirmed(corpus):
    """Windows told by hashes are those that two documents have, one by one; copies held by several documents count alone."""
    n = 13
    rows = [(" ".join(split_words(t)), i, i % 7 == 0) for i, t in corpus if len(split_words(t)) >= n]
    rows = list({t: (t, i, shared) for t, i, shared in rows}.values())
    has = collections.defaultdict(list)
    for k, (t, i, shared) in enumerate(rows):
        words = t.split(" ")
        for at in range(len(words) - n + 1):
            has[tuple(words[at : at + n])].append((k, at, i, shared))
    want = {(k, at) for x in has.values() if len({i for _, _, i, _ in x}) > 1 or any(s for *_, s in x) for k, at, _, _ in x}
    got = substring_dedup.candidates(*map(list, zip(*rows, strict=True)), n)
    assert {(k, at) for k, x in got.items() for at in x} == want and 0 < len(want) < sum(map(len, has.values()))
    assert substring_dedup.candidates([], [], [], n) == substring_dedup.candidates(["too short"], [1], [True], n) == {}


def test_pieces_reach_the_automata_as_plain_lists():
    """Columns become Python lists without a scalar for each value, and words numbers without a call for each."""
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"a": pa.array([1, -(2**62)]), "b": pa.array(["x \u00e9", ""]), "c": pa.array([True, False]), "d": pa.array([7, 8], pa.int8())})
    got = substring_dedup.lists_of(b)
    assert got == [[1, -(2**62)], ["x \u00e9", ""], [True, False], [7, 8]] and [type(c[0]) for c in got] == [int, str, bool, int]
    automaton = substring_dedup.Automaton(2)
    assert automaton.numbers("b a b") == (1, 2, 1) and automaton.numbers("c a") == (3, 2)


def test_substrings_sql(spark, data):
    _same_as_sql(spark, data, substring_dedup.op4_substring_dedup, substring_dedup.op4_sql())


def _same_as_sql(spark, data, query, sql):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = query(spark, data)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


# --- 5


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = compression_classifier.op5_quality_classifier(spark, d).collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x > y]
    assert sum(pairs) / len(pairs) > 0.9
    assert sum((s >= 0.3) == (q == 1) for s, q in held) / len(held) > 0.9


def test_classifier_special(spark):
    labels = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (99, 0), (5, None)], "doc_id long, quality int")
    model = compression_classifier.fit(special(spark), labels)
    r = {x["doc_id"]: x["score"] for x in compression_classifier.scored(special(spark), model).collect()}
    assert r[1] == r[2] == 0.0 and all(0 <= v <= 1 for v in r.values())
    empty = compression_classifier.fit(docs(spark, []), labels.limit(0))
    assert compression_classifier.scored(docs(spark, []), empty).count() == 0


# --- 6


def test_benchmark_passages_and_other_numbers(spark):
    bench = spark.createDataFrame([(1, "A train leaves the station at 30 mph and after 2 hours Anna meets Ben who walks at 3 mph toward Anna"), (2, None), (None, "x"), (3, "too short")], "item_id long, text string")
    same = "A train leaves the station at 45 mph and after 5 hours Carl meets Dora who walks at 7 mph toward Carl"
    odd = "A train leaves the station at 45 mph and after 5 hours Carl meets Dora who walks at 7 mph toward Emil"
    rows = [(1, "Well. " + same + " they say"), (2, odd), (3, PROSE), (4, None), (5, "7 8 9 Anna Ben 3 4 5 6 7 8 9 10 11 12")]
    chance = "A train leaves the station at 45 mph and after 45 hours Carl meets Dora who walks at 7 mph toward Carl"
    rows.append((6, chance))
    got = {r["doc_id"]: (list(r["_items"]), r["_windows"]) for r in decontamination.flagged(docs(spark, rows), bench).collect()}
    # A slot that breaks the run (Emil, the second 45) costs the windows that hold both ends of the contradiction, no others.
    assert {k: v[0] for k, v in got.items()} == {1: [1], 2: [1], 3: [], 4: [], 5: [], 6: [1]}
    assert got[1][1] > got[6][1] > 0 and got[1][1] >= got[2][1] > 0
    assert decontamination.clean(docs(spark, rows), bench).count() == 3
    assert decontamination.clean(special(spark), bench.limit(0)).count() == 11


def brute_templates(text, item):
    """Places of the item's windows of which the text has one with the same words or with slots that map one to one, word by word."""
    canon = decontamination.Canon()
    a, b = split_words(text), split_words(item)
    (_, held_a, _), (_, held_b, _) = canon(a), canon(b)
    kind = lambda w: decontamination.reading(w)[0]
    core = lambda w: decontamination.slot(w)
    n, found = decontamination.WINDOW, set()
    for j in range(len(b) - n + 1):
        for i in range(len(a) - n + 1):
            pairs = list(zip(range(i, i + n), range(j, j + n)))
            if all(core(a[x]) == core(b[y]) for x, y in pairs):
                found.add(j)
                continue
            alike = all(held_a[x] == held_b[y] and (core(a[x]) == core(b[y]) if not held_b[y] else (kind(a[x]), kind(b[y])) in ((decontamination.NUMBER,) * 2, (decontamination.UNIT,) * 2, (decontamination.CAPITAL,) * 2)) for x, y in pairs)
            slots = [(core(b[y]), core(a[x])) for x, y in pairs if held_b[y]]
            if alike and n - len(slots) >= decontamination.LITERALS and len(set(slots)) == len({s for s, _ in slots}) == len({t for _, t in slots}):
                found.add(j)
    return found


def test_templates_against_brute_force():
    """Random items and texts made of them by other numbers, names and units, with slots broken here and there."""
    rng = random.Random(12)
    words = "the old train of red wood leaves with five small boxes and later meets another that carries more of them".split()
    names, numbers, units = ["Anna", "Ben", "Carl", "Dora"], ["3", "7", "1,200", "45.5"], ["km", "hours", "kg", "miles"]
    for _ in range(150):
        item = " ".join(rng.choice([rng.choice(words)] * 4 + [rng.choice(names), f"{rng.choice(numbers)} {rng.choice(units)}"]) for _ in range(18))
        swap = dict(zip(names + numbers + units, rng.sample(names, 4) + rng.sample(numbers, 4) + rng.sample(units, 4)))
        text = " ".join(swap.get(w, w) if rng.random() > 0.05 else rng.choice(words) for w in item.split())
        text = "so it was said, " + text + " and no more of it"
        bench = decontamination.compiled([(1, "x " + item)])
        got = decontamination.matched(text, bench, decontamination.Canon())
        assert (got[0][1] if got else 0) == len(brute_templates(text, "x " + item))


def test_words_read_as_arrays(monkeypatch):
    """Kinds and hashes of words read as bytes, from the cache or one by one, are those of words read as texts."""
    import numpy as np
    import pyarrow as pa

    from fidelis.llm.text import pieces

    rng = random.Random(13)
    parts = ["a", "I", "Anna", "(Anna)", "don't", "3", "3,000.5", "$5", "12km", "km", "km.", "ﬁn", "Été", "“Anna”", "x.", 'x."', "--", "_a_", "Z?", ":", "a:b", "Ünit", "hours,", "1e9", "…", "."]
    monkeypatch.setattr(decontamination, "CACHE", 8)  # words push each other out
    lexicon, canon = decontamination.Lexicon(), decontamination.Canon()
    for _ in range(200):
        texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5)]
        for w in pieces(pa.array(texts)):
            got = lexicon(w)
            for row in range(len(w.off) - 1):
                if words := split_words(texts[w.first + row]):
                    for mine, want in zip(got, canon(words), strict=True):
                        assert (mine[w.off[row] : w.off[row + 1]] == want).all()
    assert not len(np.setdiff1d(np.array(lexicon.kind), np.arange(5)))


def test_benchmark_copies_that_are_short_or_full_of_slots(spark):
    items = ["Where is Mount Everest located today?", "Who wrote the novel Pride and Prejudice?", "Add 3 and 4 to Anna 7 Ben 8 Carl 9", "Paris or Rome?", "How many miles does the old red bus travel in 2 hours"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"Question 12\n{t} And then") for i, t in enumerate(items)]
    rows += [(10, "Question 12\nHow many miles does the old red bus travel in 9 hours"), (11, "Where is Mount Fuji located today?"), (12, "Add 3 and 5 to Anna 6 Ben 7 Carl 9"), (13, "a Paris and a Rome"), (14, "")]
    got = {r["doc_id"]: list(r["_items"]) for r in decontamination.flagged(docs(spark, rows), bench).collect()}
    assert got == {**{i: [i] for i in range(5)}, 10: [4], 11: [], 12: [], 13: [], 14: []}


def test_one_character_words_end_no_sentence():
    canon = decontamination.Canon()
    assert canon("He met a Carl".split())[1].tolist() == [False, False, False, True]
    assert canon('He left. Carl? "x." Carl'.split())[1].tolist() == [False] * 5


def test_benchmark_in_blocks_and_whole_items(spark, data, monkeypatch):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    truth = {i: sorted(k for k, v in items.items() if v in t) for i, t in texts.items()}
    for block in (1_000_000, 300):
        monkeypatch.setattr(decontamination, "BLOCK", block)
        got = {r["doc_id"]: r["item_ids"] for r in decontamination.op6_decontamination(spark, data).collect()}
        assert all(set(truth[i]) <= set(got[i]) for i in truth)
        assert sum(map(len, got.values())) <= sum(map(len, truth.values())) + 3


# --- 7


def brute_lines(rows, least=line_dedup.MIN_WORDS):
    """Alignment of each document with every earlier one that shares a line with it."""
    holders, out = collections.defaultdict(set), {}
    split = {i: t.split("\n") if t else [] for i, t in rows}
    norm = {i: [" ".join(split_words(x)) for x in lines] for i, lines in split.items()}
    for i in norm:
        for x in norm[i]:
            if x:
                holders[x].add(i)
    for i in norm:
        gone = set()
        for f in {f for x in norm[i] if x for f in holders[x] if f < i}:
            gone |= set(line_dedup.blocks(line_dedup.patience([x or 0 for x in norm[f]], [x or 0 for x in norm[i]]), [len(x.split()) for x in norm[i]], least))
        out[i] = gone
    return out


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 0 + 1), (2, 2)]
    assert line_dedup.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert line_dedup.patience([5, 1, 5], [5, 1, 5]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([0, 0], [0, 0]) == []
    rng = random.Random(3)
    for _ in range(300):  # rising in both, equal items, and at least the longest run of unique anchors
        a, b = ([rng.randint(1, 9) for _ in range(rng.randint(0, 9))] for _ in range(2))
        m = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
        anchors = [(a.index(x), j) for j, x in enumerate(b) if a.count(x) == 1 and b.count(x) == 1]
        best = [1] * len(anchors)
        for k, (i, _) in enumerate(anchors):
            best[k] = 1 + max((best[q] for q in range(k) if anchors[q][0] < i), default=0)
        assert len(m) >= max(best, default=0)


def test_patience_in_gaps_and_without_unique_lines(monkeypatch):
    assert line_dedup.patience([7, 8, 7, 8], [7, 8, 7, 8]) == [(0, 0), (1, 1), (2, 2), (3, 3)]  # nothing is unique
    assert line_dedup.patience([1, 5, 2, 6, 5, 3], [9, 1, 8, 5, 2, 4, 5, 3, 7]) == [(0, 1), (1, 3), (2, 4), (4, 6), (5, 7)]  # 5 is unique in each gap
    assert line_dedup.patience([3, 1, 2, 1, 2, 4], [1, 2, 1, 2]) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    rng = random.Random(5)
    for trace in (1 << 27, 6):  # 6: lists are halved
        monkeypatch.setattr(line_dedup, "TRACE", trace)
        for _ in range(300):
            a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(2))
            m, best = line_dedup.common(a, b), [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y and x else max(best[i][j + 1], best[i + 1][j])
            assert len(m) == best[-1][-1] and all(a[i] == b[j] != 0 for i, j in m)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))


def test_lines(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = brute_lines(rows)
    got = {r["doc_id"]: r for r in line_dedup.op7_line_dedup(spark, data).collect()}
    for i, t in rows:
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (len(want[i]), line_dedup.sha256(left))
    assert sum(map(len, want.values())) > 10


def test_lines_against_all_earlier_documents(spark, monkeypatch):
    """Few lines in many orders, so that the first holder of a line is often not the one that aligns with it."""
    rng = random.Random(6)
    pool = [" ".join(f"l{k}x{j}" for j in range(1 + k % 6)) for k in range(9)]
    rows = [(1, "a b c d e f\nu v w x y z"), (2, "p q r s t\nu v w x y z\nown words of two"), (3, "u v w x y z\na b c d e f\nmore words of three")]
    rows += [(i, "\n".join(rng.choice([*pool, "", f"own {i}"]) for _ in range(rng.randint(1, 9)))) for i in range(4, 90)]
    norm = {i: [" ".join(split_words(x)) for x in t.split("\n")] for i, t in rows}
    want = {}
    for i in norm:
        n = [len(x.split()) for x in norm[i]]
        want[i] = sorted(set().union(*(line_dedup.blocks(line_dedup.patience([x or 0 for x in norm[f]], [x or 0 for x in norm[i]]), n, line_dedup.MIN_WORDS) for f in norm if f < i)))
    assert want[3] == [0, 1]  # one line from document 1, the other from document 2
    for rounds in ((1, 32, 0), (1, 2, 0), (1, 0)):
        monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
        got = {r["doc_id"]: sorted(r["gone"]) for r in line_dedup.deletions(docs(spark, rows).select("doc_id", "text")).collect()}
        assert {i: got.get(i, []) for i in want} == want


def test_lines_of_rows_that_repeat_an_id(spark):
    """Only the row whose text was aligned loses lines."""
    block = "a block of six whole words\nand one more line of words"
    rows = [(1, block), (2, "a " + block), (2, f"{block}\nown"), (2, "unrelated words stay here always\nsecond line")]
    left = sorted((x["doc_id"], x["text"]) for x in line_dedup.deduplicated(docs(spark, rows)).collect())
    assert (2, "unrelated words stay here always\nsecond line") in left and (1, block) in left and len(left) == 4


def test_lines_special(spark):
    d = special(spark)
    out = line_dedup.deduplicated(d)
    assert out.columns == d.columns and out.count() == 11
    r = {x["doc_id"]: x["text"] for x in out.collect()}
    assert r[1] is None and r[7] == PROSE and r[8] == ""
    assert line_dedup.deduplicated(docs(spark, [])).count() == 0


# --- 8


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = split_words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, corpus, k):
    rows = [*corpus, (500, ""), (501, None), (502, "lone"), (503, "LONE")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.components(docs(spark, rows), k, 80).collect()}
    assert got == brute_components(rows, k, 80)


def test_members_that_only_a_chain_joins(spark, monkeypatch):
    """Each text is near the next only; blocks of two make the comparison inside bands take several tasks."""
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(base[: 60 - 2 * i] + [f"t{j}" for j in range(2 * i)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.components(docs(spark, rows), 2, 80).collect()}
    assert got == brute_components(rows, 2, 80)


def test_near_duplicates_special(spark):
    rows = near_dup.components(special(spark), 2, 80).collect()
    r = {x["doc_id"]: x for x in rows}
    assert len(rows) == 11 and r[8]["component_id"] == 7 and r[1]["n_shingles"] == 0
    assert sorted(x["n_shingles"] for x in rows if x["doc_id"] == 4) == [1, 2]  # a repeated doc_id: each row by its own text
    assert r[None]["component_id"] is None
    assert near_dup.components(docs(spark, [])).count() == 0
    d = special(spark)
    kept = near_dup.representatives(d, 2, 80)
    assert kept.columns == d.columns and kept.count() == 10 and kept.where("doc_id = 8").count() == 0


def test_repeated_ids_are_judged_by_their_own_texts(spark):
    other = PROSE.replace("river", "brook")
    rows = [(1, PROSE), (2, "words of another kind"), (2, other), (2, other), (3, other), (3, "words of a third kind")]
    got = sorted((x["doc_id"], x["n_shingles"] > 5, x["component_id"]) for x in near_dup.components(docs(spark, rows), 2, 80).collect())
    assert got == [(1, True, 1), (2, False, 2), (2, True, 1), (2, True, 1), (3, False, 3), (3, True, 1)]
    left = sorted((x["doc_id"], x["text"]) for x in near_dup.representatives(docs(spark, rows), 2, 80).collect())
    assert left == [(1, PROSE), (2, "words of another kind"), (3, "words of a third kind")]


def test_intersections_as_a_matrix_product(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64) << np.uint64(50)) for _ in range(30)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for columns in (4096, 7):
        monkeypatch.setattr(near_dup, "COLUMNS", columns)
        got = near_dup.shared_counts(sets, np.arange(0, 30, 2))
        off = ~np.eye(30, dtype=bool)[::2]  # a set's own size is not needed
        assert (got == np.array(want)[::2])[off].all()
    assert near_dup.shared_counts([sets[0], np.array([1], np.uint64)], np.array([1])).tolist() == [[0, 0]]


def test_near_duplicates_sql(spark, data):
    _same_as_sql(spark, data, near_dup.op8_minhash, near_dup.op8_sql())


def test_pruning_bounds_rise():
    least = near_dup.least_agreements(80)
    assert list(least) == sorted(least) and all(m < 0.8 * near_dup.BATCH * (n + 1) for n, m in enumerate(least))


# --- 9


def test_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 97)  # ranges far shorter than records
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    rows = [(1, "u", f"<p>{fake}</p>"), (2, None, None), (3, "x y", ""), (5, "z", "same"), (4, "q", "same"), (None, "n", "n"), (7, "a", fake), (7, "a", "b"), (8, "ü", "é\r\n\r\n" * 50), (9, "u", "x" * 5000)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(pages, f"file://{tmp_path}/a").collect()}
    body = {1: f"<p>{fake}</p>", 2: "", 3: "", 5: "same", 4: "same", 7: fake, 8: "é\r\n\r\n" * 50, 9: "x" * 5000}
    assert set(got) == set(body)
    for i, t in body.items():
        top = max(j for j, u in body.items() if u == t)
        assert got[i] == (len(t.encode()), warc.sha1_base32(t.encode()), "response" if top == i else "revisit", None if top == i else top)
    assert {r["record_type"] for r in warc.read(spark, f"file://{tmp_path}/a").collect()} == {"response", "revisit"}
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/b").count() == 0


def test_short_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "same"), (2, "same"), (3, "longer one"), (4, "longer one")], "page_id long, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archive_sql(spark, data):
    _same_as_sql(spark, data, warc.op9_warc, warc.op9_sql())


def test_large_payloads_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1000)
    monkeypatch.setattr(warc, "FILE", 4500)
    rows = [(i, str(i) * (2000 if i % 3 == 0 else 10)) for i in range(1, 31)]
    got = {r["page_id"]: r["payload_bytes"] for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, html string").coalesce(1), f"file://{tmp_path}/a").collect()}
    assert got == {i: len(t) for i, t in rows}
    import os

    sizes = [os.path.getsize(tmp_path / "a" / n) for n in os.listdir(tmp_path / "a") if n.startswith("part-")]
    assert max(sizes) < 2 * 4500 + 20 * 500 and len(sizes) >= 6


def test_broken_archive(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b"WARC/1.0\r\nContent-Length: 5\r\n\r\nabc")
    with pytest.raises(warc.BrokenArchive):
        warc.read(spark, f"file://{tmp_path}")


# --- 10


def test_scores(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in lm_scoring.op10_lm_scoring(spark, d).collect()}
    tokens = {i: [*split_words(re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = collections.Counter(w for i in texts if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    out = [got[i] for i in texts if held[i]]
    assert len(got) == len(texts) and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def _plain_scores(model, texts):
    """log10 of each text's probability, token by token, with softmaxes over plain lists."""
    import numpy as np

    from fidelis.llm.text import hashes_of

    n = model.counts
    rank = dict(zip(n.frequent.tolist(), n.rank.tolist(), strict=True))
    count = dict(zip(n.frequent.tolist(), n.counts.tolist(), strict=True))
    own = sum(c for h, c in count.items() if rank[h] < n.own)
    out = {}
    for i, t in texts.items():
        words = split_words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        tokens = [*hashes_of(words).view(np.int64).tolist(), lm_scoring.END]
        ids = [min(rank.get(h, n.own), n.own) for h in tokens]
        total, one, two = 0.0, n.own + 1, n.own + 1
        for h, k in zip(tokens, ids):
            hat = model.context[one].astype(float) @ model.last + model.context[two].astype(float) @ model.second
            soft = lambda table, at: float(table[at, :-1] @ hat + table[at, -1] - np.log(np.exp(table[:, :-1] @ hat + table[:, -1]).sum()))  # noqa: B023, E731
            kind = n.classes if k == n.own else k // n.width
            p = soft(model.kind, kind)
            if k < n.own:
                p += soft(model.word[kind * n.width : (kind + 1) * n.width], k - kind * n.width)
            total += p / math.log(10)
            if k == n.own:
                total += math.log10(count.get(h, 0) + 0.1) - math.log10(n.total - own + 0.1 * (n.distinct - n.own + 1))
            one, two = k, one
        out[i] = total
    return out


def test_scores_token_by_token(spark, data, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CONTEXTS", 50)
    d = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    counts = lm_scoring.collected(lm_scoring.token_counts(d.where(lm_scoring.fold() != 0)))
    model = lm_scoring.first_model(d.where(lm_scoring.fold() != 0), counts)  # alike each time
    assert counts.own < counts.distinct and counts.classes > 5
    want = _plain_scores(model, {r["doc_id"]: r["text"] for r in d.collect()})
    for r in lm_scoring.scored(d).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-3 * max(1, abs(want[r["doc_id"]]))


def test_probabilities_sum_to_one():
    import numpy as np

    rng = np.random.default_rng(3)
    c = np.sort(rng.integers(1, 500, 90))[::-1]
    order = rng.permutation(90)
    counts = lm_scoring.Counts(int(c.sum()) + 40, 120, np.arange(90) * 7, c[order], order, 70)
    model = lm_scoring.Model(counts)
    lm_scoring.Trainer(model, 0.1, 1).examples(*(rng.integers(0, k, 5000) for k in (72, 72, 71)))
    for one, two in ((0, 1), (70, 71), (71, 71)):
        p = model.log_probabilities(np.full(71, one), np.full(71, two), np.arange(71))
        assert abs((10.0 ** p.astype(float)).sum() - 1) < 1e-4
    empty = lm_scoring.Model(lm_scoring.Counts(0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0))
    assert abs(empty.log_probabilities(np.zeros(1, int), np.ones(1, int), np.zeros(1, int))[0]) < 1e-6
    far = np.array([[200.0, 0.0], [-200.0, -200.0]], np.float32)  # beyond what can be raised as it is
    assert np.allclose(lm_scoring._chosen(far, np.zeros(2, np.float32), np.array([1, 0])), [-200.0, -math.log(2)], atol=1e-4)


def test_model_learns_what_follows_what():
    """After training, words that always follow their context are far likelier than by their counts."""
    import numpy as np

    rng = np.random.default_rng(4)
    counts = lm_scoring.Counts(30_000, 31, np.arange(30), np.full(30, 1000), np.arange(30), 30)
    model = lm_scoring.Model(counts)
    one = rng.integers(0, 30, 40_000)
    lm_scoring.Trainer(model, 0.1, 1).examples(one, rng.integers(0, 30, 40_000), (one * 7 + 3) % 30)
    k = np.arange(30)
    assert model.log_probabilities(k, k[::-1], (k * 7 + 3) % 30).mean() > math.log10(1 / 30) + 0.8


def test_probabilities_and_times_are_those_of_plain_sums():
    """Biases that ride in the matrix products, rows that are moved whole and times counted once a chunk change no result."""
    import numpy as np

    rng = np.random.default_rng(6)
    counts = lm_scoring.Counts(5000, 60, np.arange(50), np.arange(150, 100, -1), np.arange(50), 40)
    trainer = lm_scoring.Trainer(lm_scoring.Model(counts), 0.1, 1, 64)
    one, two, nxt = (rng.integers(0, n, 3000) for n in (42, 42, 41))
    trainer.examples(one, two, nxt)
    m = trainer.model
    assert np.allclose(trainer.times["context"], np.bincount(one, minlength=42) + np.bincount(two, minlength=42), atol=0.01)
    assert np.allclose(trainer.times["word"], np.bincount(nxt[nxt < 40], minlength=40), atol=0.01)
    before = {k: v.copy() for k, v in m.tables().items()}
    at, g = np.array([3, 7, 30]), rng.normal(size=(3, lm_scoring.DIMENSIONS + 1)).astype(np.float32)
    square = trainer.square["word"][at] + g * g
    trainer.step("word", at, g)
    before["word"][at] -= 0.1 * g / np.sqrt(square)
    assert np.allclose(m.word, before["word"], atol=1e-6) and np.allclose(trainer.square["word"][at], square)
    hat = m.context[one] @ m.last + m.context[two] @ m.second
    soft = lambda x: x - np.log(np.exp(x).sum(axis=1))[:, None]
    kinds = np.where(nxt == 40, counts.classes, nxt // counts.width)
    want = soft(hat @ m.kind[:, :-1].T + m.kind[:, -1])[np.arange(len(nxt)), kinds]
    words = hat @ m.word[:, :-1].T + m.word[:, -1]
    for k in range(counts.classes):
        here = np.flatnonzero(kinds == k)
        want[here] += soft(words[here, k * counts.width : (k + 1) * counts.width])[np.arange(len(here)), nxt[here] - k * counts.width]
    assert np.allclose(m.log_probabilities(one, two, nxt), want / np.log(10), atol=1e-4)
    assert m.moved[0].shape[1] == m.kind.shape[1]


def test_training_goes_on_in_tasks(spark, monkeypatch):
    """Copies that tasks trained are averaged, and held-out texts become likelier than after the first model alone."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = lambda: lm_scoring.scored(d).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    monkeypatch.setattr(lm_scoring, "FIRST", 20_000)
    monkeypatch.setattr(lm_scoring, "ROWS", 100)
    monkeypatch.setattr(lm_scoring, "EVERY", 1)
    after = held()
    monkeypatch.setattr(lm_scoring, "trained", lambda learn, model, scratch: None)
    before = held()
    assert after[0] > before[0] and after[0] > after[1]


def test_every_token_is_trained_on(spark, data, monkeypatch):
    """Beyond what the driver trains on, the weights of the tasks' examples add up to all training tokens; nothing is drawn."""
    import numpy as np

    from fidelis.llm.store import Scratch

    monkeypatch.setattr(lm_scoring, "FIRST", 1000)
    learn = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where(lm_scoring.fold() != 0)
    counts = lm_scoring.collected(lm_scoring.token_counts(learn))
    scratch, made = Scratch(spark, "test"), []
    keep = scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df: made.append(keep(df)) or made[-1])
    monkeypatch.setattr(scratch, "drop", lambda *tables: None)
    lm_scoring.trained(learn, lm_scoring.first_model(learn, counts), scratch)
    times = sum(float(np.frombuffer(r["times"], np.float32)[0]) for t in made for r in t.where("name = 'last'").collect())
    assert counts.total > 10_000 and abs(times / counts.total - 1) < 1e-4


def test_scores_special(spark):
    rows = lm_scoring.scored(special(spark)).collect()
    r = {x["doc_id"]: x for x in rows}
    assert len(rows) == 11 and r[1]["n_tokens"] == r[2]["n_tokens"] == 1 and all(math.isfinite(x["score"]) for x in rows)
    assert r[None]["held_out"] and sorted(x["n_tokens"] for x in rows if x["doc_id"] == 4) == [2, 4]
    assert lm_scoring.scored(docs(spark, [])).count() == 0
    twice = {(x["n_known"], x["base_score"], x["score"]) for x in lm_scoring.scored(docs(spark, [(10, "only here only"), (10, "only here only")])).collect()}
    assert len(twice) == 1
