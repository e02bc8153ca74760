"""The corpus operators on small tables, against brute force; odd rows in every one of them."""

import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sheetframe.llm import bpe, classifier, components, decontam, jaccard, licenses, lines, lm, quality, sharding, toxicity

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
SHARED = "This line of more than forty characters is shared by many"
ODD = [
    (1, "one two three four five six seven"), (2, "One TWO three four five six seven"), (3, None), (4, ""), (5, " \n \t "), (6, "hi"), (7, "hi there"), (8, "HI there"), (9, LONG), (10, LONG + " end"),
    (11, "é ü 日本語 🎉 ß"), (12, f"a\n{SHARED}\nb"), (13, f"{SHARED}\n{SHARED} "), (14, f"\t{SHARED.upper()}"), (15, f"x\n{SHARED}"), (16, f"{SHARED}\n"), (17, "no\x1cbreak here\x85now"),
    (17, "no\x1cbreak here\x85now"), (None, "a row without an id, and\n" + SHARED), (18, "a # b * c ! ! ! a # b * c"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def near(seed: int, n: int = 120) -> list[str]:
    """Texts around each other: some link, some only through others, some nearly."""
    out = []
    for g in range(8):
        base = [f"g{g}w{(i * 7 + seed) % 90}" for i in range(n + 17 * g)]
        for k in range(6):
            own = list(base)
            for j in range(k):
                own[(31 * j + 5 * k) % len(own)] = f"edit{k}{j}"
            out.append(" ".join(own))
    return out


# ---- sharding ----


def test_shards(spark, odd, none):
    rows = odd.select("doc_id", "text", sharding.text_size(F.col("text")).alias("size"), F.lit("x").alias("extra"))
    for n in (1, 4, 16, 64):
        found = sharding.byte_shards(rows, n).collect()
        assert len(found) == len(ODD) and {r.extra for r in found} == {"x"}
        by = {}
        for r in found:
            by.setdefault(r.shard, []).append(r)
        total, largest = sum(r["size"] for r in found), max(r["size"] for r in found)
        for s, rs in by.items():
            assert 0 <= s < n and sorted(r.slot for r in rs) == list(range(len(rs)))
            assert sum(r["size"] for r in rs) <= total / n + largest
        order = sorted(found, key=lambda r: (r.shard, r.slot))
        assert [r.doc_id for r in order] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d or 0))
    assert sharding.byte_shards(none.withColumn("size", F.lit(1)), 4).count() == 0


def test_shards_of_one_hot_key(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(10).alias("size"))
    found = sharding.byte_shards(rows, 16).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("k")).collect()
    assert len(found) == 16 and all(abs(r.b - 1250) <= 10 and r.n == r.k for r in found)


# ---- quality ----


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(words, words[1:], words[2:]))
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(words) < 500 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, None if hit is None else len(hit)


def test_quality_measures(odd, none):
    found = quality.apply_policy(quality.ledger(quality.measure(odd)), "base/1").collect()
    assert len(found) == len(ODD)
    for r in found:
        want = brute_quality(r.text)
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert all(w is None or w == g for w, g in zip(want, got, strict=True)), r.doc_id
        assert r.kept == (r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words)
    assert quality.measure(none).count() == 0


def test_ablations(odd, none):
    rows = quality.ledger(quality.measure(odd)).cache()
    bits = [r.failed_bits for r in rows.select("failed_bits").collect()]
    for r in quality.ablations(rows, "web/1").collect():
        bit = next(1 << x.bit for x in quality.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_only, r.n_kept) == (sum(bool(b & bit) for b in bits), bits.count(bit), bits.count(0))
        assert r.n_kept_without == sum(b & ~bit == 0 for b in bits)
    assert all(r.n_kept == 0 for r in quality.ablations(quality.ledger(quality.measure(none)), "web/1").collect())


# ---- lines ----


def brute_lines(docs, min_chars, min_docs):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        stay = [x for x in ls if d is None or key(x) not in lost or lost[key(x)] == d]
        out.append((d, "\n".join(stay), len(ls), len(ls) - len(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chars", "docs"), [(40, 5), (1, 2), (5, 3)])
def test_lines(odd, none, chars, docs):
    found = lines.dedup_lines(odd, min_chars=chars, min_docs=docs).collect()
    assert sorted(map(tuple, found), key=str) == brute_lines(ODD, chars, docs)
    shuffled = lines.dedup_lines(odd, min_chars=chars, min_docs=docs, broadcast_lines=0).collect()
    assert sorted(map(tuple, shuffled), key=str) == sorted(map(tuple, found), key=str)
    assert lines.dedup_lines(none).count() == 0


def test_lines_of_one_id_with_several_texts(spark):
    docs = [(0, f"a0\n{SHARED}"), (0, "x\nthis line is nobody else's and stays\nz"), *((i, f"{SHARED}\nown {i}") for i in range(1, 6)), (0, f"a0\n{SHARED}")]
    for limit in (lines.BROADCAST_BYTES, 0):
        found = lines.dedup_lines(spark.createDataFrame(docs, SCHEMA), broadcast_bytes=limit).collect()
        assert sorted(map(tuple, found), key=str) == brute_lines(docs, 40, 5)


# ---- hashes ----


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_patterned_words_do_not_collide(spark):
    """Words that collide under any polynomial modulo a power of two, through every operator that hashes words or lines."""
    x = thue_morse(2048)
    y = x.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{x}\n{y}"), (2, f"{x} c d"), (3, f"{y} c d"), (4, x), (5, y)], SCHEMA)
    assert {r.n_dup_lines for r in quality.measure(docs).collect()} == {0}
    assert all(r.component_id == r.doc_id for r in jaccard.similarity_components(docs, n=1, percent=60).collect() if r.doc_id != 1)
    assert sorted(map(tuple, lm.scores(docs.withColumn("text", F.col("text"))).select("doc_id", "n_words", "n_backed_off", F.round("lm_score", 6)).collect()), key=str) == brute_lm([tuple(r) for r in docs.collect()])


# ---- n-gram Jaccard ----


def brute_jaccard(docs, n=3, percent=90):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([d for d in sets if d is not None], 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("block", [jaccard.BLOCK, 500])
def test_jaccard(spark, monkeypatch, odd, none, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = [*ODD, *((100 + i, t) for i, t in enumerate(near(3))), *((200 + i, t.upper()) for i, t in enumerate(near(3)[:5]))]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_components(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()}
    assert found == brute_jaccard(docs)
    if block == jaccard.BLOCK:
        assert jaccard.similarity_components(none).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_part_keys_meet_and_trees_agree(percent):
    import numpy as np

    rng = np.random.default_rng(percent)
    sets = []
    for size in (8, 9, 11, 12, 13, 40, 170, 900):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        for k in (0, 1, max(1, size * (100 - percent) // 230), max(1, size * (100 - percent) // 150)):
            own = base.copy()
            own[:k] = rng.integers(0, 2**63, k, dtype=np.uint64)
            sets.append(np.unique(own))
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keys, texts = jaccard.part_keys(np.concatenate(sets), of, np.array([len(s) for s in sets]), percent)
    have = {i: set(keys[texts == i].tolist()) for i in range(len(sets))}
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        alike = 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
        assert jaccard.similar(sets[i], sets[j], percent) == alike
        if alike and both < max(len(sets[i]), len(sets[j])):
            assert have[i] & have[j], (i, j)
    found = jaccard.linked(sets, None, percent)
    root = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if jaccard.similar(sets[i], sets[j], percent):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert found.tolist() == root


@pytest.mark.parametrize("percent", [10, 30, 50, 66])
def test_sets_several_bands_apart(spark, percent):
    """One set inside another, as much smaller as the percentage allows: they have a key in common and link."""
    import numpy as np

    rng = np.random.default_rng(percent)
    for small in (2, 4, 5, 10, 40):
        large = small * 100 // percent
        sets = [np.sort(rng.integers(0, 1 << 63, large, dtype=np.uint64))]
        sets.append(np.sort(rng.permutation(sets[0])[:small]))
        keys, texts = jaccard.part_keys(np.concatenate(sets), np.repeat([0, 1], [large, small]), np.array([large, small]), percent)
        assert set(keys[texts == 0].tolist()) & set(keys[texts == 1].tolist()), (small, large)
    docs = [(1, "a b c d"), (2, "a b c d e f g h"), (3, "x y z w")]
    if percent == 50:
        out = {r.doc_id: r.component_id for r in jaccard.similarity_components(spark.createDataFrame(docs, SCHEMA), n=1, percent=50).collect()}
        assert out == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1), *((i, i + 1) for i in range(100, 160)), *((500, 501 + i) for i in range(50))]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 5)}, **{i: 7 for i in (7, 8, 9)}, **{i: 100 for i in range(100, 161)}, **{500 + i: 500 for i in range(51)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- language model ----


def brute_lm(docs):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    one = [{w: ws.count(w) for w in set(ws)} if len(ws) < 500 else {} for ws in words]
    for i, ws in enumerate(words):
        if len(ws) >= 500:
            for w in ws:
                one[i][w] = one[i].get(w, 0) + 1
    two = []
    for ws in words:
        c = {}
        for p in zip(ws, ws[1:]):
            c[p] = c.get(p, 0) + 1
        two.append(c)
    all1, all2 = {}, {}
    for own, total in ((one, all1), (two, all2)):
        for c in own:
            for k, n in c.items():
                total[k] = total.get(k, 0) + n
    size = sum(map(len, words))
    out = []
    for (d, _), ws, o, t in zip(docs, words, one, two, strict=True):
        s, backed = 0.0, 0
        for i, w in enumerate(ws):
            p = (ws[i - 1], w)
            if i and all2[p] > t[p]:
                s += math.log10((all2[p] - t[p]) / (all1[p[0]] - o[p[0]]))
            else:
                f = all1[w] - o[w]
                s, backed = s + math.log10(0.4 * (f or 0.5) / size), backed + 1
        out.append((d, len(ws), backed, round(s / len(ws), 6) if ws else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_lm(odd, none, blocks):
    found = lm.scores(odd, blocks=blocks).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_backed_off, None if r.lm_score is None else round(r.lm_score, 6)) for r in found), key=str) == brute_lm(ODD)
    assert lm.scores(none).count() == 0


def test_packing():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    n = rng.integers(1, 2**62, len(keys))
    k, c = lm.unpack(lm.pack(keys, n))
    assert (k == keys).all() and (c == n).all()


# ---- toxicity ----


def toxic_corpus():
    docs, labels = [], []
    for i in range(400):
        plain = " ".join(f"word{(i * 13 + j * 7) % 300}" for j in range(40))
        toxic = i % 4 == 0
        if toxic:
            w = plain.split()
            for k in range(3):
                w.insert((i + 11 * k) % len(w), f"zorg{'abcdefgh'[(i + k) % 8]}")
            plain = " ".join(w)
        docs.append((i, plain))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_learns_beginnings_of_words(spark, odd, none):
    docs, labels = toxic_corpus()
    d, ls = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, ls)
    assert any(p.startswith("zorg") or p == "zor" for p in model.prefixes)
    rows = toxicity.score(d, model).select("doc_id", "toxicity", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all((r.toxicity >= 0.5) == (r.doc_id % 4 == 0) for r in rows if r.held)
    found = {r.doc_id: r.toxicity for r in toxicity.score(odd, model).collect()}
    assert all(0 <= x < 0.5 for x in found.values()) and found[3] == found[4]
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, ls).words and toxicity.fit(d, ls.where("toxic = 0")).words


def brute_events(symbols, reach, negate=True, report=True, target=True):
    """What the four transducers say of a clause, read off its definition."""
    out, end = [], "t" if target and "T" in symbols else ""
    for i, x in enumerate(symbols):
        if x == "K":
            x = "X" if "M" in symbols[max(0, i - reach) : i] else "."
        if x in "IX":
            x += "n" * (negate and "N" in symbols[max(0, i - reach) : i]) + "r" * (report and "R" in symbols[:i])
        out.append(x if x[0] in "IX" else ".")
    return out, end


@pytest.mark.parametrize("off", [{}, {"negate": False}, {"report": False}, {"target": False}])
def test_composition_of_transducers(off):
    rng = random.Random(5)
    for reach in (1, 4):
        machine = toxicity.grammar(reach, **off)
        for _ in range(1500):
            symbols = [rng.choice("IKMTNR...") for _ in range(rng.randrange(0, 12))]
            assert machine.run(symbols) == brute_events(symbols, reach, **off), symbols


def test_clauses():
    read = toxicity.Reader(toxicity.Lexicon({"grub": 4.0}, {"vexe": 2.0}))
    clause = lambda t: read.clause(t.split())
    assert clause("a plain clause") == {} and clause("grub") == {"I": 4.0} and clause("you grub") == clause("grub you") == {"It": 4.0}
    assert clause("vexe") == {} and clause("vexes grub grub") == {"I": 4.0}  # repeating a word in its clause adds nothing
    assert clause("not a grub") == {"In": 4.0} and clause("said vexes") == {"Ir": 2.0} and clause("nicht du grub") == {"Int": 4.0}
    assert clause("will kill you") == {"Xt": toxicity.PRIOR} and clause("kill time") == {}
    assert read.text("A GRUB. fine. grub, you") == {"I": 4.0, "It": 4.0} and read.text("agrub grubs") == {}
    far = " ".join(["word"] * 4000)
    assert read.text(f"grub {far} you. grub") == {"It": 4.0, "I": 4.0} and read.text(f"not. grub {far}") == {"I": 4.0}


def test_every_transducer_changes_verdicts():
    """Toxic texts insult somebody; clean ones deny it, quote it or insult nobody. Without a transducer, the model can't tell."""
    lexicon = lambda: toxicity.Lexicon({"grub": 4.0})
    texts = [("you are a grub", True)] * 60 + [("nobody is a grub", False)] * 40 + [("she said he is a grub", False)] * 40 + [("a grub in the garden", False)] * 40
    verdicts = {}
    for off in ("", "negate", "report", "target"):
        machine = toxicity.grammar(**({off: False} if off else {}))
        read = toxicity.Reader(lexicon(), machine)
        points = [([read.text(t).get(p, 0.0) for p in toxicity.PATTERNS], y, 1) for t, y in texts]
        model = toxicity._weighted(lexicon(), points, ridge=0.1)
        verdicts[off] = [model.score(read.text(t)) >= 0.5 for t in ("you are a grub", "you are not a grub", "he said you are a grub", "a grub in the garden")]
    assert verdicts[""] == [True, False, False, False]
    assert all(verdicts[off] != verdicts[""] for off in ("negate", "report", "target"))


# ---- classifier ----


def test_classifier(spark, odd, none):
    good = [(i, " ".join(f"Word{(i * 7 + j * j) % 900}" if j % 9 == 0 else f"word{(i * 31 + j * j * 3) % 900}" for j in range(80)) + ".") for i in range(200)]
    bad = [(1000 + i, ["spam! " * 60, "## $$ a%b " * 40, "SHOUT LOUD! " * 30, "same same line\n" * 30][i % 4] + f"x{i}") for i in range(60)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    model, scorer = classifier.fit(docs)
    found = {r.doc_id: (r.kept, r.weak_label) for r in classifier.classify(docs, model, scorer).collect()}
    assert sum(found[i][0] for i, _ in good) >= 198 and sum(not found[i][0] for i, _ in bad) >= 58
    assert 0.6 < model.good < 0.9
    rows = classifier.classify(odd, model, scorer, keep=("doc_id",)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.quality_score <= 1 for r in rows)
    empty = classifier.fit(none)
    assert classifier.classify(none, *empty).count() == 0 and all(r.kept for r in classifier.classify(odd, *empty).collect())


# ---- licences ----


def test_licenses(spark, odd, none):
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + licenses.MIT
    docs = [
        (1, "Copyright 1999 A. B.\nAll rights reserved.\n" + licenses.MIT.upper().replace("\n\n", " \n ")), (2, "text\nReleased under the MIT licence!\nmore"), (3, "Licensed  under the Apache Licence, ver. 2.0"),
        (4, mit), (5, "Released under the MIT License and more"), (6, "intro\n\nlicensed under\nthe MIT license\n\nend"), (7, None), (8, ""), (9, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."),
    ]
    found = {(r.doc_id, r.license): (r.n_whole, r.n_blocks, r.n_lines) for r in licenses.scan(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert found == {(1, "MIT"): (1, 1, 0), (2, "MIT"): (0, 0, 1), (3, "Apache-2.0"): (1, 0, 1), (6, "MIT"): (0, 1, 0), (9, "CC-BY-NC-4.0"): (0, 0, 2)}
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
    far = [(1, licenses.MIT + "\n" * 9000), (2, "Released under the MIT License.\n" + "\n \n" * 20_000), (3, licenses.MIT.replace(" ", " " * 40))]
    found = {r.doc_id: (r.license, r.n_whole) for r in licenses.scan(spark.createDataFrame(far, SCHEMA)).collect()}
    assert found == {1: ("MIT", 1), 2: ("MIT", 1), 3: ("MIT", 1)}  # white space is no part of a text, however much


def test_full_and_embedded_licenses(spark):
    """Full texts, alone, with a title and inside longer documents, as the query looks for them."""
    from pathlib import Path

    texts = {p.stem: p.read_text() for p in Path(licenses.__file__).with_name("license_texts").glob("*.txt")}
    names = sorted(texts)
    docs = [(i, texts[n]) for i, n in enumerate(names)] + [(100 + i, f"A program.\n\n{texts[n]}\n\nAnd its readme.") for i, n in enumerate(names)]
    docs += [(200, "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + licenses.MIT), (201, "\n".join(f" * {x}" for x in ("Tool.\n\n" + licenses.ISC + "\n\ncode").split("\n"))), (202, licenses.MIT[:-9] + "\n\nend")]
    rows = licenses.scan(spark.createDataFrame(docs, SCHEMA), known=licenses.full_texts(), runs=True).collect()
    found = {(r.doc_id, r.license): (r.n_whole, r.n_blocks) for r in rows}
    for i, name in enumerate(names):
        assert found[i, name][0] == 1 and found[100 + i, name][0] == 0 and found[100 + i, name][1] >= 1, name
    assert found[200, "MIT"] == (1, 1) and found[201, "ISC"] == (0, 1) and not any(d == 202 for d, _ in found)


# ---- byte-level BPE ----


def test_bpe_against_the_library(spark, odd, none):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*(t for _, t in ODD), "".join(map(chr, range(1, 0x250))), "don't I'll we've 1234 ½²  \n\n x", "a" * 3000, "܀bar▁under", "<|endoftext|>", "🎉" * 50 + "\r\n\t"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    rows = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    both = bpe.encode_decode(docs, ranks, P.PATTERN, keep=["doc_id"]).collect()
    assert {r.doc_id: r.ids for r in both} == {r.doc_id: r.ids for r in rows}
    assert bpe.encode(none, ranks, P.PATTERN).count() == 0


def test_splitter_is_the_pattern():
    import public_tokenizers as P
    import regex

    split, full = bpe.splitter(P.PATTERN), regex.compile(P.PATTERN).findall
    for t in ("".join(map(chr, range(0x300))), "a\x1c\x1d\x85\xa0 b  c", "ª² ½x ǅ 'll'LL", "  \n x \t"):
        assert split(t) == full(t)


def test_bpe_with_few_remembered(monkeypatch):
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    texts = [[f" tok{i}en{i * i}" for i in range(k, k + 50)] for k in range(0, 400, 40)]
    want = bpe.Encoder(ranks).encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    small = bpe.Encoder(ranks)
    assert [small.encode([t])[0] for t in texts] == want


# ---- decontamination ----


def passage(k, n=40):
    return [f"b{k}t{(i * i + k) % 211}" for i in range(n)]


def test_decontamination(spark, odd, none):
    items = [(i, " ".join(passage(i))) for i in range(4)] + [(9, "too short"), (10, None), (11, " ".join(passage(11, 9))), (0, " ".join(passage(0)))]
    pad = [f"pad{i}" for i in range(30)]
    swap = lambda ws, every: [f"sub{i}" if i % every == every - 1 else w for i, w in enumerate(ws)]
    docs = [
        (1, " ".join(pad + passage(0) + pad)), (2, ", ".join(pad + swap(passage(1), 5)).upper()), (3, " ".join(swap(passage(2), 2))), (4, " ".join(passage(3)[15:])), (5, " ".join(passage(3)[:20] + pad)),
        (6, " ".join(passage(11, 9))), (7, " ".join(passage(0)[:7])), (8, " ".join(passage(0) + pad + passage(0))), (1, " ".join(pad + passage(0) + pad)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([*docs, (None, docs[0][1])], SCHEMA)
    want = {(1, 0): (40, 30), (2, 1): (32, 30), (4, 3): (25, -15), (5, 3): (20, 0), (6, 11): (9, 0), (8, 0): (40, 0)}
    for limit in (decontam.BROADCAST_SEEDS, 0):  # broadcast and shuffled seeds
        rows = decontam.contaminated(table, bench, broadcast_seeds=limit).collect()
        assert {(r.doc_id, r.item): (r.n_equal, r.first_token) for r in rows} == want and len(rows) == len(want)
    left = decontam.decontaminate(table, bench).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [3, 7] and any(r.doc_id is None for r in left)
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(table, bench.limit(0)).count() == 0


def test_masks_tolerate_any_one_substitution():
    span = len(decontam.MASKS[0])
    for at in range(span + 4):  # somewhere around a changed token, some mask at some position still agrees
        assert any(all(m[k] == "0" or p + k != at for k in range(span)) for p in range(5) for m in decontam.MASKS)


@pytest.mark.parametrize("percent", [50, 75, 90, 100])
@pytest.mark.parametrize("width", range(1, 17))
def test_masks_are_complete(width, percent):
    """Some mask fits wherever as many tokens are changed as may be."""
    changed = width - math.ceil(width * percent / 100)
    masks = decontam.complete_masks(width, changed)
    fits = lambda m, at, gone: at + len(m) <= width and not any(x == "1" and at + k in gone for k, x in enumerate(m))
    for gone in itertools.combinations(range(width), changed):
        assert any(fits(m, at, gone) for m in masks for at in range(width)), (masks, gone)


def brute_passages(docs, items, stretch=16, percent=75):
    out = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        t, b = text.split(), item.split()
        w = min(len(b), stretch)
        for shift in range(-len(b), len(t)):
            eq = [0 <= k + shift < len(t) and t[k + shift] == x for k, x in enumerate(b)]
            if max(sum(eq[k : k + w]) for k in range(len(b) - w + 1)) * 100 >= w * percent and sum(eq) > out.get((d, i), (0, 0))[0]:
                out[d, i] = (sum(eq), shift)
    return out


def test_decontamination_against_brute_force(spark):
    """Items of 1 to 24 tokens, changed at random and at regular places: all that the rule names are found."""
    rng = random.Random(3)
    items = [(n, " ".join(f"i{n}t{k}" for k in range(n))) for n in range(1, 25)]
    docs = [(10_000 + n, f"some other words i{n}t0 then") for n in range(1, 25)]
    for n, text in items:
        for every in (4, 5, 8):
            docs.append((100 * n + every, " ".join("x" if k % every == every - 1 else w for k, w in enumerate(text.split()))))
        for k in range(12):
            words = ["x" if rng.random() < 0.2 else w for w in text.split()]
            docs.append((100 * n + 20 + k, " ".join([*["pad"] * (k % 3), *words, "end"])))
    found = decontam.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_passages(docs, items)
    assert {(r.doc_id, r.item): (r.n_equal, r.first_token) for r in found} == want and len(found) == len(want)
    assert {(2404, 24), (1604, 16), (708, 7)} <= set(want)


# ---- columns whose names clash ----

CLASH = "shard slot _tie _part row s total b b_before n_lines n_dropped _lost _lines id t lines h1 h2 keeper pos n_words failed_bits kept ids decoded toxicity weak_label quality_score component_id n_shingles rep c d1 d2 n lm_score n_backed_off block license digest item h seed shift form _key _text".split()


def test_clashing_columns(spark, odd):
    """Columns with the names of results are replaced, others stay, and none disturbs a result."""
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    clash = odd.select("*", *(F.lit("x").alias(c) for c in CLASH))
    bench = spark.createDataFrame([(1, LONG[:300])], "item_id long, text string")
    empty = classifier.fit(odd.limit(0))
    operators = {
        "shards": lambda d: sharding.byte_shards(d.withColumn("size", sharding.text_size(F.col("text"))), 4, order=("doc_id", "text")), "quality": lambda d: quality.apply_policy(quality.ledger(quality.measure(d)), "web/1"), "lines": lambda d: lines.dedup_lines(d, min_chars=5, min_docs=2),
        "jaccard": jaccard.similarity_components, "lm": lm.scores, "toxicity": lambda d: toxicity.score(d, toxicity.Lexicon({"hi": 3.0})), "classifier": lambda d: classifier.classify(d, *empty), "licenses": licenses.scan,
        "bpe": lambda d: bpe.decode(bpe.encode(d, ranks, P.PATTERN), ranks), "decontamination": lambda d: decontam.contaminated(d, bench), "decontaminate": lambda d: decontam.decontaminate(d, bench),
    }
    for name, f in operators.items():
        plain, odd_one = f(odd), f(clash)
        assert len(set(odd_one.columns)) == len(odd_one.columns), name
        cols = sorted(plain.columns)
        assert sorted(map(str, odd_one.select(*cols).collect())) == sorted(map(str, plain.select(*cols).collect())), name
