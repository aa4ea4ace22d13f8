"""Telling hand-written source from generated, minified, vendored files and data saved as code."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import materialize, ship

LANGUAGES = {"py": "python", "js": "javascript", "java": "java", "go": "go"}

# Reserved words, which say nothing about who named things.
RESERVED = {
    "python": frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda match case nonlocal not or pass raise return try while with yield self cls".split()),
    "javascript": frozenset("await async break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new null return super switch this throw true false try typeof undefined var void while with yield of require module exports".split()),
    "java": frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if implements import instanceof int interface long native new null package private protected public record return short static super switch synchronized this throw throws transient true false try var void volatile while String".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false int int32 int64 string bool byte error float64".split()),
}

_NOISE = {
    "python": re.compile(r"#[^\n]*|[rbfuRBFU]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"),
    "javascript": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"),
    "java": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"),
}
# What stands before the first statement, whatever its length: comments, a docstring, a package clause, a directive.
_LEADING = {
    k: re.compile(r"\ufeff?(?:#![^\n]*)?(?:\s+|" + c + r")*+")
    for k, c in {
        "python": r"#[^\n]*|[rRuU]?(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')", "javascript": r"//[^\n]*|/\*[\s\S]*?\*/|[\"']use strict[\"'];?",
        "java": r"//[^\n]*|/\*[\s\S]*?\*/|package [\w.]+ *;", "go": r"//[^\n]*|/\*[\s\S]*?\*/|package \w+",
    }.items()
}
_NAME = re.compile(r"(?<![\w$])[A-Za-z_$][A-Za-z0-9_$]*")
_SHAPE = re.compile(r"[A-Za-z0-9_$]+")
_IMPORT = re.compile(r"(?:import|from|package|using)\b|(?:const|var|let) .{0,80}\brequire\(|[\"')(};]+$")
_DATA = re.compile(r"(?:[-+]?\b(?:0x[0-9a-fA-F]+|\d[\d.eE]*)\b[\s,;:\[\](){}]*){6,}|[A-Za-z0-9+/=\\]{32,}")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")

# Notices that tools and bundlers leave in comments at a file's head.
GENERATED_NOTICE = re.compile(
    r"@generated\b|\bauto-?generated\b|\bcode generated by\b|\b(?:automatically|machine)[ -](?:created|generated|written)\b|\bgenerated (?:by|from|file)\b.*\b(?:do not|don't|edit|modif)"
    r"|\bdo not (?:edit|modify)\b|\boutput, regenerate with\b|\bmanual changes? will be (?:lost|overwritten)\b|自动生成|請勿手動|请勿(?:手动)?修改", re.I)  # fmt: skip
VENDORED_NOTICE = re.compile(
    r"\bvendored from\b|\bthird[- ]party copy\b|\bcopied (?:verbatim )?from the\b|^\W*upstream: *https?:|\bv\d+\.\d+\.\d+ *\| *[\w.-]+[ -]licen[cs]e|@preserve\b|@license\b", re.I | re.M)
VENDORED_PATH = re.compile(
    r"(?:^|/)(?:vendor|vendored|_vendor|third[_-]party|thirdparty|extern|externals?|deps|node_modules|bower_components|site-packages|Godeps)/"
    r"|(?:^|/)[\w.]*[A-Za-z]\w*-v?\d+\.\d+(?:\.\d+)*(?:/|\.\w+$|\.min\.\w+$)|-[A-Za-z]\w*-v?\d+\.\d+\.\d+\.\w+$")  # fmt: skip
GENERATED_PATH = re.compile(r"_pb2(?:_grpc)?\.py$|\.pb\.go$|\.(?:gen|generated|g)\.\w+$|_generated\.\w+$|(?:^|/)(?:generated|gen-src|autogen)/|(?:^|/)zz_generated|_pb2\.\w+$|parsetab\.py$")
MINIFIED_PATH = re.compile(r"[.-]min\.\w+$")

SCHEMA = (
    "file_version_id string, repo string, path string, language string, chars int, lines int, names int, distinct int, words array<string>, counts array<int>, short double, longest int,"
    " dense double, shapes double, figures double, templated double, snake double, generated boolean, vendored boolean, vendored_path boolean, generated_path boolean, minified_path boolean, styled_snake int, styled int"
)


def features(path: str, language: str, text: str) -> tuple:
    """Names with their counts, and the shares that SCHEMA lists from `short` on."""
    head = _LEADING[language].match(text).group()
    code = _NOISE[language].sub('""', text)
    reserved = RESERVED[language]
    names = Counter(x for x in _NAME.findall(code) if x not in reserved)
    n = sum(names.values())
    lines = [x.strip() for x in code.split("\n")]
    lines = [x for x in lines if x]
    raw = [len(x) for x in text.split("\n")]
    body = [x for x in lines if not _IMPORT.match(x)]
    shape = Counter(_SHAPE.sub("w", x) for x in body)
    solid = sum(len(x) for x in lines) or 1
    long = sum(len(x) for x in lines if len(x) > 240)
    packed = sum(len(x) for x in lines if len(x) > 100 and x.count(" ") * 8 < len(x))
    data = sum(len(x) for x in _DATA.findall(text))
    wordy = [x for x in names if len(x) > 3]
    styled_snake = sum("_" in x.strip("_") for x in wordy)
    styled = sum("_" in x.strip("_") or x[1:].lower() != x[1:] for x in wordy)
    form = {x: _DIGITS.sub("#", _WORD.sub("w", x)) for x in names if _DIGITS.search(x)}
    family = Counter(form.values())
    templated = sum(names[x] for x, f in form.items() if family[f] >= 5) / max(1, n)
    common = sum(c for s, c in shape.most_common(6) if len(s) > 4)
    return (
        len(text), len(lines), n, len(names), list(names), list(names.values()),
        sum(c for x, c in names.items() if len(x) <= 2) / max(1, n), max(raw, default=0), max(long, packed) / solid, common / max(1, len(body)),
        data / max(1, len(text)), templated, styled_snake / max(1, styled), bool(GENERATED_NOTICE.search(head)), bool(VENDORED_NOTICE.search(head)),
        bool(VENDORED_PATH.search(path)), bool(GENERATED_PATH.search(path)), bool(MINIFIED_PATH.search(path)), styled_snake, styled,
    )


def _trigrams(word: str):
    w = f"^{word}$"
    return (w[i : i + 3] for i in range(len(w) - 2))


def classify(evidence: DataFrame, mangled: float = 0.55, odd: float = 0.35, short: float = 0.3, figures: float = 0.5, templated: float = 0.3, shapes: float = 0.8, foreign: float = 0.6, support: int = 8) -> DataFrame:
    """(file_version_id, repo, path, language, kind, excess): one row per file version of a known extension with a file
    unit; kind is minified, data, generated, vendored or null for hand-written source.

    A character trigram model of each language is counted over the names of all its files, once per file; a file's
    cross-entropy is compared with the language's median, `excess` bits over it.
    - minified: names over `mangled` bits in excess, of which a share of over `short` have one or two characters, or a
      path that says so.
    - data: numbers and unbroken literals fill over `figures` of the text.
    - generated: over `templated` of the names are numbered members of one template; or six line shapes make up over
      `shapes` of a body, by more than three lines, whose names are `odd` bits in excess; or what precedes the first statement or the path say so.
    - vendored: what precedes the first statement or the path says so; or the names' style, the share of those joined
      by underscores, is `foreign` to the repository's other files of that language, although they are names of the
      language by their entropy. Both shares are drawn towards the language's with the weight of `support` names or
      files, so that few of them say little.
    Notices count before the first statement only, so a file that speaks of generated code is no case.

    The model has at most 65^3 trigrams a language, which bounds the broadcast. Null content counts as empty, an empty
    file is hand-written, a null path has no extension; repeated rows give one row; other columns are ignored."""
    spark = evidence.sparkSession
    ship(spark)
    language = F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.regexp_extract("path", r"\.(py|js|java|go)$", 1))
    src = (
        evidence.where("unit_type = 'file' and file_version_id is not null")
        .select("file_version_id", F.coalesce("repo", F.lit("")).alias("repo"), "path", language.alias("language"), F.coalesce("content", F.lit("")).alias("content"))
        .where("language is not null")
    )
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def look(frames):
        for f in frames:
            rows = [(i, r, p, k, *features(p, k, t)) for i, r, p, k, t in f[["file_version_id", "repo", "path", "language", "content"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=names)

    seen = materialize(src.mapInPandas(look, SCHEMA), "names")

    def count(frames):
        c: dict[str, Counter] = {}
        for f in frames:
            for k, words in zip(f["language"], f["words"]):
                own = c.setdefault(k, Counter())
                for w in words:
                    own.update(_trigrams(w))
        rows = [(k, g, n) for k, own in c.items() for g, n in own.items()]
        yield pd.DataFrame(rows, columns=["language", "gram", "n"])

    grams = seen.select("language", "words").mapInPandas(count, "language string, gram string, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    model: dict[str, dict[str, int]] = {}
    for r in grams.toLocalIterator():
        model.setdefault(r.language, {})[r.gram] = r.n
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def entropy(kind: pd.Series, words: pd.Series, counts: pd.Series) -> pd.Series:
        if not hasattr(shared, "bits"):
            tables = {}
            for k, own in shared.value.items():
                heads = Counter()
                for g, n in own.items():
                    heads[g[:2]] += n
                tables[k] = ({g: -math.log2((n + 0.1) / (heads[g[:2]] + 6.4)) for g, n in own.items()}, {h: -math.log2(0.1 / (n + 6.4)) for h, n in heads.items()})
            shared.bits, shared.known = tables, {}
        out, known = [], shared.known
        for k, ws, cs in zip(kind, words, counts):
            bits, rest = shared.bits.get(k, ({}, {}))
            own = known.setdefault(k, {})
            total = n = 0.0
            for w, c in zip(ws, cs):
                x = own.get(w)
                if x is None:
                    grams = list(_trigrams(w))
                    x = (sum(bits[g] if g in bits else rest.get(g[:2], 6.0) for g in grams), len(grams))
                    if len(own) >= 500_000:
                        own.clear()
                    own[w] = x
                total += c * x[0]
                n += c * x[1]
            out.append(total / n if n else 0.0)
        return pd.Series(out)

    scored = materialize(seen.withColumn("bits", entropy("language", "words", "counts")).drop("words", "counts"), "scores")
    middle = scored.where("names > 0").groupBy("language").agg(F.percentile_approx("bits", 0.5, 1000).alias("middle"))
    c = F.col
    x = scored.join(F.broadcast(middle), "language", "left").withColumn("excess", F.coalesce(c("bits") - c("middle"), F.lit(0.0)))
    # Shares of snake names, drawn towards the language's by as much as `support` names or files weigh.
    common = scored.groupBy("language").agg(F.try_divide(F.sum("styled_snake"), F.sum("styled")).alias("common"))
    own = scored.groupBy("repo", "language").agg(F.sum("snake").alias("all_snake"), F.count("*").alias("files"))
    x = x.join(F.broadcast(common), "language", "left").join(own, ["repo", "language"], "left")
    prior = F.coalesce(c("common"), F.lit(0.5))
    mine = (c("styled_snake") + support * prior) / (c("styled") + support)
    rest = (c("all_snake") - c("snake") + support * prior) / (c("files") - 1 + support)
    vendored = c("vendored_path") | c("vendored") | ((F.abs(mine - rest) >= foreign) & (c("excess") < odd / 2))
    kind = (
        F.when(c("lines") == 0, None)
        .when(c("figures") > figures, F.when(c("generated") | c("generated_path") | (c("templated") > templated), "generated").otherwise("data"))
        .when(c("minified_path") | ((c("excess") > mangled) & (c("short") > short)), "minified")
        .when(c("generated") | c("generated_path") | (c("templated") > templated) | ((c("excess") > odd) & (c("shapes") > shapes) & (c("lines") * (c("shapes") - shapes) > 3)), "generated")
        .when(F.coalesce(vendored, F.lit(False)), "vendored")
    )
    return x.withColumn("kind", kind).groupBy("file_version_id").agg(*(F.max(n).alias(n) for n in ("repo", "path", "language", "kind", "excess")))
