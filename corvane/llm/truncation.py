"""Texts cut off by field limits or in transfer."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import materialize, release, ship

MARK = re.compile(r" ?(?:…|\.\.\.|\[(?:\.\.\.|…)\]|[\[(<][^\[\]()<>\n]*(?:clipped|truncated|cut off|omitted|gekürzt|tronqué|truncado|截断)[^\[\]()<>\n]*[\])>])\s*$")
TOKEN = re.compile(r"\n\s*\n|[\u3040-\u30ff\u3400-\u9fff]|[^\W\u3040-\u30ff\u3400-\u9fff]+(?:[./:@-][^\W\u3040-\u30ff\u3400-\u9fff]+)*|[^\w\s]")
ENDS = frozenset(".!?。！？…\n")
PART = re.compile(r"[^\W\d_]?[^\W\d_A-Z]+|[^\W\d_]+")
BRACKETS = {"{": "}", "[": "]"}
ORDERS = 6
FILTER_BITS = 1 << 22
FINDINGS = "mark boolean, chars int, bytes int, ended boolean, open boolean, word string, tail array<string>, closing string"


def classes(text: str) -> list[str]:
    """Tokens by class: words in lower case, @ for identifiers and paths, # for numbers, a line feed for a paragraph's
    end; other tokens as they are."""
    out = []
    for t in TOKEN.findall(text):
        if t[0] == "\n":
            out.append("\n")
        elif t.isalpha():
            out.append("@" if t[1:] != t[1:].lower() else t.lower())
        elif t.isdigit():
            out.append("#")
        elif t[0].isalnum() or t[0] == "_":
            out.append("@")
        else:
            out.append(t)
    return out


def unclosed(text: str) -> bool:
    """Whether a code fence, a JSON value or an inline construct of the last sentence is still open at the end."""
    if len(re.findall(r"^\s*```", text, re.M)) % 2:
        return True
    head = text.lstrip()[:1]
    if head in BRACKETS and re.match(r"\s*(?:\{\s*(?:\"|$)|\[)", text):
        try:
            json.loads(text)
            return False
        except ValueError:
            depth, quoted, skip = 0, False, False
            for c in text:
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = c == "\\", c != '"'
                elif c == '"':
                    quoted = True
                else:
                    depth += (c in "{[") - (c in "}]")
            return quoted or depth > 0
    last = re.split(r"\n\s*\n", re.sub(r"```.*?```", "", text, flags=re.S))[-1]  # the whole paragraph: a span may run over lines
    if last.count("`") % 2:
        return True
    depth = 0
    for c in re.findall(r"[()]", re.split(r"[.!?。！？]\s", last)[-1]):
        depth = depth + 1 if c == "(" else max(0, depth - 1)  # a list's "a)" closes nothing
    return depth > 0


def masked(paragraph: str) -> str:
    """A paragraph with its names and numbers masked."""
    return re.sub(r"@[\w-]+|(?<=-- \n)[\w-]+", "@", re.sub(r"\d+", "#", paragraph.strip()))


def inspect(text: str) -> tuple:
    """What FINDINGS lists: an end mark, lengths before it, whether the text ends like a whole one, what stands open,
    the last word or part of an identifier if letters end the text, the classes of the last tokens, and the last of
    several paragraphs with its names and numbers masked."""
    m = MARK.search(text)
    core = text[: m.start()] if m else text
    body = core.rstrip()
    last = body[-1:]
    sign = re.search(r"https?://\S+$|<\|\w+\|>$", body)
    closing = body.rsplit("\n\n", 1)
    closing = masked(closing[1]) if len(closing) > 1 else ""
    ended = bool(sign) or not (last.isalnum() or last in "_,;:(-`/\"'[{=+&" or last in "，；：、（") or bool(re.search(r"[.!?。！？][\"'`)\]”»]*$|```$", body))
    parts = PART.findall(body.rsplit(None, 1)[-1]) if last.isalpha() and not "\u3040" <= last <= "\u9fff" else []
    return bool(m), len(core), len(core.encode("utf-8", "surrogatepass")), ended, unclosed(body), parts[-1].lower() if parts else "", classes(body)[-ORDERS:], closing


def _poisson_tail(n: int, mean: float) -> float:
    """P(X >= n) for n over the mean; else 1, which is no less than it."""
    if n <= mean:
        return 1.0
    term = math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))  # the largest, as terms fall beyond the mean
    total, k = 0.0, n
    while term > 1e-18 * max(total, 1e-300):
        total += term
        k += 1
        term *= mean / k
    return min(1.0, total)


def limits(lengths: DataFrame, reach: int = 25, rate: float = 0.01, least: int = 3, lift: float = 2.0) -> DataFrame:
    """(source, measure, mark, length, n, expected, p): lengths at which texts of a source end far more often than at
    the lengths around.

    `lengths` has source, measure, mark, length, unended. The hazard of a length is the share of the texts at least so
    long that end there. Its expected count comes from the hazards around, itself left out: the greatest of their mean
    within `reach` lengths, their mean within 4, and the third highest within 4, since two limits may stand side by
    side but the peak of a distribution has high neighbours on both sides. The hypothesis tested is that the hazard is
    at most `lift` times the expected one, so that the unevenness of lengths that people choose, which any fixed ratio
    of 1 would find significant in a corpus large enough, is no limit at any size. p is the Poisson tail;
    Benjamini-Hochberg keeps the false-discovery rate under `rate` per source. A length needs `least` texts, with
    unended ones among them."""
    own = ["source", "measure", "mark"]
    n = lengths.groupBy(*own, "length").agg(F.count("*").alias("n"), F.sum(F.col("unended").cast("int")).alias("cut"))
    risk = Window.partitionBy("source", "measure", "mark").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy(*own).orderBy("length").rangeBetween(-reach, reach)
    close = Window.partitionBy(*own).orderBy("length").rangeBetween(-4, 4)
    mean = lambda around, risks, k: F.col("risk") * (F.col(around) + 0.5) / (k * F.col(risks))
    cells = (
        n.withColumn("risk", F.sum("n").over(risk)).withColumn("around", F.sum("n").over(near) - F.col("n"))
        .withColumn("risks", F.max("risk").over(near)).withColumn("beside", F.sum("n").over(close) - F.col("n")).withColumn("beside_risks", F.max("risk").over(close))
        .withColumn("hazards", F.sort_array(F.collect_list(F.struct((F.col("n") / F.col("risk")).alias("h"), "length")).over(close), asc=False))
        .withColumn("third", F.try_element_at(F.filter("hazards", lambda x: x["length"] != F.col("length")), F.lit(3))["h"])
        .withColumn("expected", F.greatest(mean("around", "risks", 2 * reach), mean("beside", "beside_risks", 8), F.coalesce(F.col("third") * F.col("risk"), F.lit(0.0))))
        .where((F.col("n") >= least) & (F.col("cut") >= least))
    )

    @F.pandas_udf("double")
    def tail(n: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([_poisson_tail(int(a), float(b)) for a, b in zip(n, mean)])

    total = n.groupBy("source").agg(F.count("*").alias("tests"))
    order = Window.partitionBy("source").orderBy("p", "measure", "mark", "length")
    cells = cells.withColumn("p", tail("n", F.col("expected") * lift)).join(total, "source").withColumn("rank", F.row_number().over(order))
    passed = cells.where(F.col("p") <= F.col("rank") * rate / F.col("tests")).groupBy("source").agg(F.max("rank").alias("last"))
    return cells.join(passed, "source").where("rank <= last").select(*own, "length", "n", "expected", "p")


def _bit(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) & (FILTER_BITS - 1)


def _second_look(full: DataFrame, frequent, wanted, closings) -> DataFrame:
    """(key, n, ends, copy). For each context of up to ORDERS tokens that the filter of wanted bits lets pass, of all
    tokens but each text's last: how often it occurs, and how often a sentence ends after it. As wanted contexts come
    with all their ends, a context whose end isn't wanted needs no look. Rows with a `copy`: that text has the closing
    `key` as the beginning of a paragraph that goes on."""

    def run(frames):
        common, bits, short = frequent.value, wanted.value, closings.value
        sizes = sorted({len(c) for c in short})
        seen: Counter = Counter()
        ends: Counter = Counter()
        is_wanted: dict[str, bool] = {}

        def flush(more=()):
            keys = list(seen)
            out = [(k, seen[k], ends[k], None) for k in keys] + [(x, 0, 0, c) for x, c in more]
            seen.clear()
            ends.clear()
            return pd.DataFrame(out, columns=["key", "n", "ends", "copy"])

        for f in frames:
            going = []
            for text, copy in zip(f["text"], f["copy"]):
                kept = [t if t in common or not t.isalpha() else "*" for t in classes(text)]
                for i in range(len(kept) - 1):
                    key = kept[i]
                    if key in ENDS:
                        continue
                    end = kept[i + 1] in ENDS
                    for k in range(1, ORDERS + 1):
                        ok = is_wanted.get(key)
                        if ok is None:
                            if len(is_wanted) >= 500_000:
                                is_wanted.clear()
                            h = _bit(key)
                            ok = is_wanted[key] = bool(bits[h >> 3] >> (h & 7) & 1)
                        if not ok:
                            break
                        seen[key] += 1
                        if end:
                            ends[key] += 1
                        if i < k:
                            break
                        key = kept[i - k] + " " + key
                if short:
                    heads = {masked(x) for x in re.split(r"\n\n+", text)}
                    going += [(x, copy) for x in {h[:k] for h in heads for k in sizes if k < len(h)} & short]
            if going or len(seen) > 200_000:
                yield flush(going)
        yield flush()

    return full.select("text", "copy").mapInPandas(run, "key string, n long, ends long, copy string")


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", common: int = 6000, known: int = 6, least: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """(findings, limits). findings: key, source, truncated, reason, chars for every row with a key.

    A text is truncated if it doesn't end like a whole one, and (a) its length before an end mark, in code points or in
    UTF-8 bytes, is a significant limit of its source, where copies count once; or, as a transfer breaks off at any
    length and leaves no limit to find, unless it ends in a closing, (b) a code fence, JSON value, bracket or code span
    stands open, (c) its last word, or part of an identifier, is 50 times rarer within texts than the words that it
    begins, or (d) the longest of its last one to six tokens that occur `known` times in the corpus end a sentence in
    under `least` of those cases. A closing is a last paragraph that `known` texts and 1 in `common` share, copies
    counted once, and that no more texts have as the beginning of a paragraph that goes on, as they would a fragment.
    Copies of a truncated text, whatever the source and white space, are truncated. Words rarer than 1 in `common`
    tokens count as one class, so the words kept are at most `common`, and so are the closings.

    Two passes read the texts whole. The first writes endings and word counts; the second counts contexts, but only
    those in which a suspect ends: a filter of FILTER_BITS bits, of that size whatever the corpus, keeps the others out
    of the shuffle, and the join after it is exact.

    Null, empty and blank texts are not truncated; a null source is a source of its own; rows with a null key are left
    out; repeated keys give one row; other columns are ignored."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    base = docs.select(F.col(key).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id is not null")
    full = base.where("trim(text) <> ''").withColumn("copy", F.md5(F.trim(F.regexp_replace("text", r"\s+", " "))))
    columns = ["mark", "chars", "bytes", "ended", "open", "word", "tail", "closing"]

    def look(frames):
        for f in frames:
            rows = [inspect(t) for t in f["text"]]
            yield f[["id", "source", "copy"]].assign(**pd.DataFrame(rows, columns=columns, index=f.index), n=pd.array([None] * len(f), "Int64"))
            c: Counter = Counter()
            for t in f["text"]:
                tokens = TOKEN.findall(t)[:-1]
                c.update(w.lower() for w in tokens if w.isalpha())
                c.update(p.lower() for w in tokens if len(w) > 1 and w != w.lower() or "_" in w for p in PART.findall(w))
            n = len(c)
            yield pd.DataFrame({"id": [None] * n, "source": [None] * n, "copy": [None] * n, **{x: [None] * n for x in columns}, "n": list(c.values())}).assign(word=list(c))

    schema = f"id {base.schema['id'].dataType.simpleString()}, source string, copy string, {FINDINGS}, n long"
    both = materialize(full.mapInPandas(look, schema), "endings")
    seen = both.where("n is null").drop("n")
    vocabulary = materialize(both.where("n is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    measure = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("length"))))
    once = seen.select("source", "copy", "mark", "ended", "chars", "bytes").distinct()
    lengths = once.select("source", "mark", (~F.col("ended")).alias("unended"), measure.alias("m")).select("source", "mark", "unended", "m.*")
    found = materialize(limits(lengths), "limits")
    total = vocabulary.agg(F.sum("n")).head()[0] or 0
    frequent = sc.broadcast(frozenset(r.word for r in vocabulary.where(F.col("n") * common >= total).toLocalIterator()) | {"@", "#"})

    enough = F.col("closed") >= F.greatest(F.lit(known), F.lit((seen.agg(F.approx_count_distinct("copy")).head()[0] or 0) / common))
    closings = closings_of = materialize(seen.where("closing <> ''").groupBy("closing").agg(F.countDistinct("copy").alias("closed")).where(enough), "closings")
    short = sc.broadcast(frozenset(r.closing for r in closings.select("closing").toLocalIterator()))  # each is the only one of its texts, so `common` at most
    suspect = "not ended or (open and ended and tail[size(tail) - 1] = '\"')"

    def keys(frames):
        for f in frames:
            rows = []
            for i, tail in zip(f["id"], f["tail"]):
                kept = [t if t in frequent.value or not t.isalpha() else "*" for t in tail]
                rows += [(i, k, x, _bit(x)) for k in range(1, len(kept) + 1) for x in [" ".join(kept[-k:])]]
            yield pd.DataFrame(rows, columns=["id", "order", "key", "bit"])

    tails = materialize(seen.where(suspect).select("id", "tail").mapInPandas(keys, f"id {base.schema['id'].dataType.simpleString()}, order int, key string, bit int"), "tails")
    bits = bytearray(FILTER_BITS // 8)
    for r in tails.select("bit").distinct().toLocalIterator():  # FILTER_BITS at most
        bits[r.bit >> 3] |= 1 << (r.bit & 7)
    wanted = sc.broadcast(bytes(bits))
    second = materialize(_second_look(full, frequent, wanted, short), "contexts")
    goes_on = second.where("copy is not null").groupBy(F.col("key").alias("closing")).agg(F.countDistinct("copy").alias("open_ended"))
    closings = closings.join(goes_on, "closing", "left").where("open_ended is null or open_ended <= closed").select("closing", "closed")
    suspects = seen.where(suspect).join(closings, "closing", "left")

    contexts = second.where("copy is null").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).where(F.col("n") >= known)
    best = tails.join(contexts, "key").groupBy("id").agg(F.max_by(F.struct("n", "ends"), "order").alias("c"))
    at = found.select("source", "mark", "measure", "length")
    s = suspects.join(at.where("measure = 'chars'").select("source", "mark", F.col("length").alias("chars"), F.lit(True).alias("at_chars")), ["source", "mark", "chars"], "left")
    s = s.join(at.where("measure = 'bytes'").select("source", "mark", F.col("length").alias("bytes"), F.lit(True).alias("at_bytes")), ["source", "mark", "bytes"], "left")
    # Words that begin as a suspect's last word does: prefixes of the lengths that these words have.
    last = seen.where(suspect).where("word <> ''").select("word").distinct()
    sizes = [r.n for r in last.select(F.length("word").alias("n")).distinct().collect()]
    heads = F.explode(F.transform(F.filter(F.array(*(F.lit(x) for x in sorted(sizes))).cast("array<int>"), lambda k: k < F.length("word")), lambda k: F.substr("word", F.lit(1), k)))
    longer = vocabulary.select(heads.alias("word"), "n").join(last, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("longer"))
    s = s.join(vocabulary.select("word", F.col("n").alias("seen")), "word", "left").join(longer, "word", "left").join(best, "id", "left")
    reason = (
        F.when(~F.col("ended") & F.coalesce("at_chars", "at_bytes", F.lit(False)), "limit")
        .when(F.col("closed").isNotNull(), None)
        .when(F.col("open"), "open")
        .when((F.col("word") != "") & (F.coalesce("seen", F.lit(0)) * 50 < F.col("longer")), "word")
        .when(F.col("c.ends") < F.col("c.n") * least, "sentence")
    )
    s = materialize(s.select("id", "copy", reason.alias("reason")).where("reason is not null"), "cut")
    release(vocabulary, closings_of, tails, second)
    copies = s.groupBy("copy").agg(F.min("reason").alias("of"))
    result = seen.join(copies, "copy", "left").groupBy("id").agg(F.max("of").alias("reason"))
    findings = (
        base.groupBy("id").agg(F.min("source").alias("source"), F.max(F.length("text")).alias("chars")).join(result, "id", "left")
        .select(F.col("id").alias(key), "source", F.col("reason").isNotNull().alias("truncated"), "reason", "chars")
    )
    return findings, found


def rates(findings: DataFrame) -> DataFrame:
    """(source, documents, truncated, rate)."""
    cut = F.sum(F.col("truncated").cast("int"))
    return findings.groupBy("source").agg(F.count("*").alias("documents"), cut.alias("truncated"), F.round(cut / F.count("*"), 6).alias("rate"))
