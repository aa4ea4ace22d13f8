"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import itertools
import random
import re
import time

from pyspark.sql import functions as F

from corvane.llm import automaton, bpe, handwritten, mixing, neardup, overlap, secrets, split, truncation, validity
from corvane.llm.tokens import TOKEN_RE

EVIDENCE = "evidence_id string, file_version_id string, repo string, path string, unit_type string, symbol string, start_line int, end_line int, content string, metadata string, doc string, n int, bands string, line_no int, p string"


def evidence(spark, rows):
    """rows: (evidence_id, file_version_id, path, unit_type, content); the last columns' names clash with inner ones."""
    return spark.createDataFrame([(e, f, "r", p, u, None, 1, None, c, None, "x", 1, "y", 2, "z") for e, f, p, u, c in rows], EVIDENCE)


BODY = "\n".join(f"def f{i}(a, b):\n    return a + b * {i}" for i in range(40))
ROWS = [
    ("e1", "f1", "a.py", "file", BODY), ("e1", "f1", "a.py", "file", BODY), ("e2", "f2", None, "file", None), ("e3", "f3", "b.js", "file", ""), (None, None, "c.go", "file", "package a"), ("e4", "f4", "d.py", None, "x"),
    ("e5", "f5", "e.py", "function", BODY.replace("f7", "g7")), ("e6", "f6", "e.py", "function", BODY), ("e7", "f7", "big.json", "file", "[" + "1," * 200_000 + "1]"), ("e8", "f8", "x.py", "file", "def f(:\n"), ("e9", "f9", "k.env", "file", "DB_PASSWORD=Flush@6888\n")]


def test_split(spark):
    df = evidence(spark, ROWS)
    got = split.split_oversized(df, limit=300).collect()
    assert {r.evidence_id for r in got} == {"e5", "e6"} and all(r.rendered_token_count <= 300 for r in got)
    assert split.split_oversized(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    df = evidence(spark, ROWS)
    pairs = neardup.duplicate_pairs(*neardup.near_duplicates(df))
    assert [tuple(r) for r in pairs.collect()] == [("e5", "e6")]
    m, links = neardup.near_duplicates(df)
    g = {r.evidence_id: r.group_id for r in neardup.groups(m, links).collect()}
    assert g["e5"] == g["e6"] != g["e1"]
    assert neardup.duplicate_pairs(*neardup.near_duplicates(df.limit(0))).count() == 0


def test_near_duplicates_brute_force(spark):
    import random

    r = random.Random(1)
    base = [" ".join(f"w{r.randrange(60)}" for _ in range(80)) for _ in range(6)]
    rows = []
    for k, b in enumerate(base):
        for j in range(6):
            w = b.split()
            for _ in range(j):
                w[r.randrange(len(w))] = f"z{r.randrange(99)}"
            rows.append((f"e{k}{j}", f"f{k}{j}", "a.py", "method", " ".join(w)))
    grams = lambda t: {tuple(x) for x in zip(*(TOKEN_RE.findall(t)[i:] for i in range(3)))}
    want = {(a[0], b[0]) for a, b in itertools.combinations(sorted(rows), 2) if len(grams(a[4]) & grams(b[4])) >= 0.7 * len(grams(a[4]) | grams(b[4]))}
    got = {tuple(x) for x in neardup.duplicate_pairs(*neardup.near_duplicates(evidence(spark, rows))).collect()}
    assert got <= want and len(got) >= len(want) - 1 and len(want) > 20


def test_near_duplicates_that_repeat_differently(spark):
    """Copies whose lines recur: sets at 0.9 and over, bags under 0.5."""
    rows = []
    for k in range(40):
        lines = [f"row{k} {'abcdefghij'[j]}{k} = {j} ;" for j in range(10)]
        rows += [(f"e{k}a", f"f{k}a", "a.py", "method", "\n".join(lines)), (f"e{k}b", f"f{k}b", "a.py", "method", "\n".join(lines + lines[5:] * 8))]
    sets, multi = neardup.jaccard(*([x[4].encode() for x in rows[i::2]] for i in (0, 1)))
    assert sets.min() >= 0.9 and multi.max() < 0.5
    got = {tuple(x) for x in neardup.duplicate_pairs(*neardup.near_duplicates(evidence(spark, rows))).collect()}
    assert got == {(f"e{k}a", f"e{k}b") for k in range(40)}


def test_chain_is_one_group(spark):
    links = spark.createDataFrame([(i, i + 1, 0.9, 0.9) for i in range(1, 30)] + [(50, 51, 0.9, 0.9)], "class_a long, class_b long, similarity double, bag_similarity double")
    members = spark.createDataFrame([(f"e{i}", f"f{i}", "t", i) for i in [*range(1, 31), 50, 51, 60]], "evidence_id string, file_version_id string, unit_type string, class_id long")
    got = neardup.groups(members, links).groupBy("group_id").agg(F.count("*").alias("n"), F.sum("links").alias("l")).collect()
    assert sorted((r.group_id, r.n, r.l) for r in got) == [(1, 30, 58), (50, 2, 2), (60, 1, 0)]


def test_overlap(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [("t1", "train", words), ("t1", "train", words), ("v1", "validation", words.upper() + "!"), ("v2", "benchmark", words.replace("six", "sex")), ("v3", "benchmark", "one two three"), ("v4", "validation", None), ("v5", "validation", ""),
            ("t2", "train", "a b"), ("t3", None, words), ("v6", "benchmark", "unlike any other text of all"), ("t4", "train", words + " thirteen"), ("t1", "benchmark", words), (None, "train", words)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "task_id string, split string, problem_statement string, doc string, words int")
    g = lambda t: {tuple(x) for x in zip(*(re.findall("[a-z0-9]+", (t or "").lower())[i:] for i in range(3)))}
    want = {(e[0], t[0]) for e in rows for t in rows if e[1] in ("validation", "benchmark") and t[1] == "train" and e[0] and t[0] and e[0] != t[0] and g(e[2]) and g(t[2]) and len(g(e[2]) & g(t[2])) >= 0.6 * len(g(e[2]) | g(t[2]))}
    for shard in (30, 1 << 20):
        pairs, coverage = overlap.cross_split_overlap(df, shard_bytes=shard)
        got = pairs.collect()
        assert {(r.eval_id, r.train_id) for r in got} == want and len(got) == len(want)
        cover = {r.eval_id: r.coverage for r in coverage.collect()}
        assert set(cover) == {e for e, _ in want} and cover["v1"] == 1.0
    assert [x.count() for x in overlap.cross_split_overlap(df.limit(0))] == [0, 0]


def test_scan_by_shards(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 5)))
    texts = [(f"t{i}", " ".join(word() for _ in range(r.randrange(0, 40)))) for i in range(200)] + [("n", None), ("e", "")]
    patterns = [(p,) for p in sorted({f" {word()} {word()} " for _ in range(150)})]
    want = {(k, p, i, i + len(p) - 1) for k, t in texts if t for (p,) in patterns for i in range(len(t)) if t.startswith(p, i)}
    t, p = spark.createDataFrame(texts, "k string, t string"), spark.createDataFrame(patterns, "p string")
    for shard in (1 << 20, 300):
        got = automaton.scan(t, "k", "t", p, "p", shard_bytes=shard, salts=3).collect()
        assert {(x.k, x.p, s["first"], s["last"]) for x in got for s in x.spans} == want
        assert len({(x.k, x.p) for x in got}) == len(got)


def test_common_lengths_are_no_limits(spark):
    r = random.Random(5)
    lengths = [round(r.gauss(35, 4)) for _ in range(60_000)] + [50] * 400
    df = spark.createDataFrame([("a", "chars", False, n, True) for n in lengths], "source string, measure string, mark boolean, length int, unended boolean")
    assert [x.length for x in truncation.limits(df).collect()] == [50]


def test_foreign_style_is_vendored(spark):
    r = random.Random(9)
    words = "river stone cloud maple ember quiet north amber field grain".split()
    snake = lambda: "\n".join(f"{r.choice(words)}_{r.choice(words)} = {r.choice(words)}_{r.choice(words)}({r.choice(words)}_{r.choice(words)})" for _ in range(30))
    camel = lambda: "\n".join(f"{r.choice(words)}{r.choice(words).title()} = {r.choice(words)}{r.choice(words).title()}({r.choice(words)}{r.choice(words).title()})" for _ in range(30))
    rows = [(f"f{i}", "repo", f"src/m{i}.py", "file", snake()) for i in range(30)] + [("odd", "repo", "src/odd.py", "file", camel())]
    rows += [(f"g{i}", "other", f"src/m{i}.py", "file", camel()) for i in range(20)]
    got = handwritten.classify(spark.createDataFrame(rows, "file_version_id string, repo string, path string, unit_type string, content string")).where("kind is not null").collect()
    assert [(x.file_version_id, x.kind) for x in got] == [("odd", "vendored")]


def test_classify(spark):
    blob = "X = [\n" + "".join("    0x%02x, 0x%02x, 0x%02x, 0x%02x,\n" % (i, i * 7 % 256, i * 3 % 256, i * 5 % 256) for i in range(200)) + "]\n"
    mangled = ";".join(f"{a}{i}=lambda {b},{c}:{b}*{i}+{c}" for i in range(60) for a, b, c in ["abc", "xyz"])
    hand = "\n".join(f"def load_{w}(reader, limit):\n    total = reader.{w}(limit)\n    if total is None:\n        raise ValueError(reader)\n    return total\n" for w in "record window policy carrier matter signal".split())
    rows = [*ROWS, ("g1", "g1", "x/gen.py", "file", "# Code generated by tool v1. DO NOT EDIT.\n" + hand), ("g2", "g2", "a/blob.py", "file", blob), ("g3", "g3", "vendor/lib/a.py", "file", hand), ("g4", "g4", "a/m.py", "file", mangled),
            ("h1", "h1", "vendor_tools/a.py", "file", 'BANNER = "Code generated by tool. DO NOT EDIT."\n' + hand), *((f"h{i}", f"h{i}", f"src/a{i}.py", "file", hand.replace("limit", f"bound{'abcdefgh'[i % 8]}")) for i in range(2, 12))]
    got = {r.file_version_id: r.kind for r in handwritten.classify(evidence(spark, rows)).collect()}
    assert got["g1"] == "generated" and got["g2"] == "data" and got["g3"] == "vendored" and got["g4"] == "minified"
    assert got["h1"] is None and got["h5"] is None and got["f3"] is None and "f2" not in got and "f9" not in got
    assert handwritten.classify(evidence(spark, ROWS).limit(0)).count() == 0


def test_notices_behind_licences():
    licence = "Licensed under the Apache License, Version 2.0; you may use this file in compliance with it.\n"
    notice = "Code generated by tool v1. DO NOT EDIT."
    flag = lambda language, text: handwritten.features("a", language, text)[13]
    assert flag("go", "//go:build x\n\n" + ("// " + licence) * 60 + f"\n// {notice}\n\npackage a\n")
    assert flag("go", "/*\n" + licence * 20 + f"*/\n\n/*\n{notice}\n*/\npackage a\n") and flag("java", "/*\n" + licence * 2 + f"{notice}\n*/\nclass A {{}}\n")
    assert flag("python", "#!/usr/bin/env python\n" + ("# " + licence) * 20 + f"# {notice}\nx = 1\n") and flag("javascript", "#!/usr/bin/env node\n/*\n" + licence * 20 + f"{notice} */\nf()\n")
    for language, text in (("go", "package a\n" + "var x = 1\n" * 20 + f"// {notice}\n"), ("python", "# a\n" * 20 + f'X = "{notice}"\n'), ("javascript", "// a\n" * 20 + f"f('// {notice}')\n"), ("java", "/* a\n" * 20), ("go", "")):
        assert not flag(language, text), text
    assert handwritten.features("a", "go", "//" + " x" * 3000 + f"\n// {notice}\npackage a\n")[13]
    name = "record" * 20 + "Qzx"
    assert list(handwritten._trigrams(name))[-1] == "zx$"


def test_secrets(spark):
    shared = [(f"s{i}", f"s{i}", f"d{i}/c{i}.yaml", "file", f"name{i}_token: Sample-Value-77\n") for i in range(8)]
    df = evidence(spark, [*ROWS, ("m", "m", "n.md", "file", "x\nuse Flush@6888 here\n"), *shared]).withColumn("repo", F.col("file_version_id"))
    found, _ = secrets.find_secrets(df)
    assert {(r.file_version_id, r.line_no) for r in found.collect()} == {("f9", 1), ("m", 2)}
    out = {r.file_version_id: r.content for r in secrets.redacted(df, found).collect()}
    assert out["f9"] == "DB_PASSWORD=xxxxx-xxxx\n" and out["m"] == "x\nuse xxxxx-xxxx here\n"
    assert secrets.find_secrets(df.limit(0))[0].count() == 0


def test_validity(spark):
    got = {r.file_version_id: r.error_line for r in validity.judge(evidence(spark, ROWS)).collect()}
    assert got == {"f1": None, "f3": None, "f7": None, "f8": 1}
    assert validity.rates(validity.judge(evidence(spark, ROWS))).where("language = 'python'").head().rate == 0.5
    assert validity.judge(evidence(spark, ROWS).limit(0)).count() == 0


def test_encode(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "don't <|endoftext|>", "k"), (3, "x " * 50_000, "k")], "doc_id long, text string, ids string")
    got = {len(r.ids): r.doc_id for r in bpe.encode(df).collect()}
    assert set(got) >= {0} and bpe.encode(df).schema["ids"].dataType.simpleString() == "array<int>" and bpe.encode(df.limit(0)).count() == 0
    assert sorted(r.n for r in bpe.encode(df, out="n", counts=True).collect())[:2] == [0, 0]


def test_mix(spark):
    docs = [(i, "ab c"[i % 3 : i % 3 + 1] or "a", f"word{i % 7} text of some kind {i}") for i in range(300)]
    rows = [(i, ["a", "b", "c"][i % 3] if i % 10 else "a", t) for i, _, t in docs] + [(900, "a", None), (901, None, "x"), (902, "other", "x y"), (None, "a", "x"), (0, "a", docs[0][2])]
    df = spark.createDataFrame([(*r, 5, 0.5) for r in rows], "doc_id long, source string, text string, tokens int, u double")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, None), ("c", 0.2, 1), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    uses, shares = mixing.mix(df, targets)
    cap = {"a": 2, "b": 1, "c": 1}
    assert all(0 < r.uses <= cap[r.source] for r in uses.collect())
    got = {r.source: r.actual_share for r in shares.collect()}
    assert all(abs(got[s] - t) < 0.02 for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.2))) and got["none"] == 0
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


def test_truncation(spark):
    import random

    r = random.Random(3)
    nouns = "reader writer planner window carrier record signal".split()
    sentence = lambda: f"The {r.choice(nouns)} should respect the {r.choice(nouns)} before it returns the {r.choice(nouns)}."
    whole = [" ".join(sentence() for _ in range(r.randrange(1, 9))) for _ in range(400)]
    long = [" ".join(sentence() for _ in range(12))[:500] for _ in range(40)]
    rows = [(i, "s", t) for i, t in enumerate(whole)] + [(1000 + i, "s", t) for i, t in enumerate(long)]
    rows += [(2000, "s", None), (2001, "s", ""), (2002, "s", " \n"), (2003, None, "All is well."), (2004, "s", "The reader should respect the"), (2005, "s", "The writer should resp"), (2006, "s", "The reader should respect the window before it returns the planner"), (None, "s", "x"), (5, "s", whole[5])]
    df = spark.createDataFrame([(*x, 1, "w") for x in rows], "doc_id long, source string, text string, chars int, word string")
    findings, found = truncation.truncated(df)
    got = {x.doc_id: x.truncated for x in findings.collect()}
    assert [x.length for x in found.where("measure = 'chars'").collect()] == [500]
    assert all(got[1000 + i] for i, t in enumerate(long) if not t.rstrip().endswith("."))
    assert not any(got[i] for i in range(400)) and got[2004] and got[2005] and not (got[2000] or got[2001] or got[2002] or got[2003] or got[2006])
    assert truncation.truncated(df.limit(0))[0].count() == 0


def test_closings(spark):
    import random

    r = random.Random(4)
    nouns = "reader writer planner window carrier record signal".split()
    sentence = lambda: f"The {r.choice(nouns)} {r.randrange(10**6)} should respect the {r.choice(nouns)} before it returns the {r.choice(nouns)}."
    body = lambda k=3: "\n\n".join(sentence() for _ in range(k))
    repost = body(2) + "\n\nTh"
    texts = [("whole", body(r.randrange(1, 9))) for _ in range(300)]
    texts += [("repost", repost)] * 7  # copies of one cut
    texts += [("fragment", body() + "\n\nThe rea") for _ in range(8)]  # a beginning that many texts share
    texts += [("thanks", body() + "\n\nThanks for the") for _ in range(8)]
    texts += [("limit", (body(9)[:480] + "x" * 480)[:463] + "\n\nThanks for the") for _ in range(12)]  # all of one length
    texts += [("copies", "One of the reposts has no end mark at all")] * 30
    df = spark.createDataFrame([(i, "s", t) for i, (_, t) in enumerate(texts)], "doc_id long, source string, text string")
    findings, found = truncation.truncated(df)
    got = {}
    for x in findings.collect():
        got.setdefault(texts[x.doc_id][0], set()).add(x.reason)
    assert got["whole"] == {None} and got["thanks"] == {None} and got["limit"] == {"limit"}
    assert None not in got["repost"] | got["fragment"] and "limit" not in got["repost"] | got["copies"]


def test_unlike_pairs_are_dropped_in_their_bucket(spark, monkeypatch):
    seen = {}
    plain = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name="stage": seen.setdefault(name, df) and plain(df, name))
    same = " ".join(f"w{i}" for i in range(80))
    members, links = neardup.near_duplicates(evidence(spark, [(f"e{i}", f"f{i}", "a.txt", "file", same if i < 2 else f"{same} tail{i}") for i in range(4)]))
    join = next(x for x in seen["met"]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "bit_count" in join  # before the pairs are counted, which shuffles them
    assert neardup.most_unequal(128, 0.7) == 37 and neardup.most_unequal(128, 1.0) == 0
    pairs = neardup.duplicate_pairs(members, links)
    assert sorted(map(tuple, pairs.collect())) == [(f"e{i}", f"e{j}") for i in range(4) for j in range(i + 1, 4)]
    twice = members.unionByName(members.where("evidence_id = 'e0'").withColumn("class_id", F.col("class_id") + 1))
    assert sorted(map(tuple, neardup.duplicate_pairs(twice, links).collect())) == sorted(map(tuple, pairs.collect()))


def test_materialize_leaves_no_shuffle(spark):
    from corvane.session import materialize

    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    written = materialize(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and written.count() == 10
