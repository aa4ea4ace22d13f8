"""Credentials embedded in source, configuration and text files."""

from __future__ import annotations

import base64
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.automaton import scan
from corvane.session import materialize, ship

# Parts of names that hold credentials; last parts of names that only speak of them.
SECRET_PARTS = frozenset("password passwd pwd passphrase pass pw secret token apikey credential credentials auth authorization bearer passcode psk".split())
KEY_OWNERS = frozenset("api access private signing encryption service secret master account storage shared app client license deploy".split())
SPEAKS_OF = frozenset(
    "header headers field name names path url uri file filename dir env var label hash digest checksum ttl expiry expires length size type count regex pattern prefix suffix placeholder policy"
    " hint param parameter public id ids timeout error message format column ref version scope provider mode enabled required kind limit budget budgets endpoint host class".split())  # fmt: skip
CONFIG = frozenset("env ini toml yaml yml properties cfg conf json".split())

LITERAL = re.compile(r"\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`([^`\n]*)`")
NAME_BEFORE = re.compile(r"([A-Za-z_$][\w.$-]*)[\"'`\])]*\s*(?::\s*(?:final\s+)?\w*\s*)?(?::=|=>|=|:|\(|,)\s*(?:[rbuf]\b)?$")
BARE = re.compile(r"(?<![\w.-])([A-Za-z_][\w.-]*)[ \t]*(?:=|:)[ \t]*(?=([^\s\"'`#,;(){}\[\]]{6,}))")
SPOKEN = re.compile(r"\b(password|passwd|pwd|token|secret)(?:\s+is)?[ :]+[\"'`]?([^\s\"'`,;()]{6,})", re.I)
PAIR = re.compile(r"(?:(?<=[;?&])|(?<=[\"'`]))[ \t]*([A-Za-z][\w-]*)[ \t]*=[ \t]*([^;&\"'`\s]{6,})")
URL = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s/:@\"'<>]*:([^\s/@\"'<>]{3,})@", re.I)
SCHEME = re.compile(r"\b(Bearer|Basic|Token)\s+([A-Za-z0-9+/_=.~-]{8,})")
# Formats of issued credentials.
STRUCTURED = re.compile(
    r"(?<![\w.-])(eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}|A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|[A-Za-z]{2,5}[_.-](?:[A-Za-z0-9]{4,24}[_.-])?[A-Za-z0-9]{20,})(?![\w-])")  # fmt: skip
ISSUED = re.compile(r"eyJ[\w-]{8,}\.eyJ|A[KS]IA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30,}$|xox[abprs]-|[sr]k_(?:live|test)_")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
BODY = re.compile(r"[A-Za-z0-9+/=\s\"'\\,]*")
# Every line that line_candidates accepts, or that opens a private key, has a hit: in each form, what it can't do without.
HINT = re.compile(
    "|".join(
        [
            *sorted(x for x in SECRET_PARTS if not any(y in x for y in SECRET_PARTS - {x})),
            rf"(?:{'|'.join(sorted(KEY_OWNERS))})(?a:[^A-Za-z\n]*)key",
            r"basic[^\S\n]+[A-Za-z0-9+/_=.~-]{8}",
            r"://[^\s/:@\"'<>]*:[^\s/@\"'<>]{3,}@",
            r"[\"'`](?:[^\S\n]*\+[^\S\n]*|[^\S\n]+)[\"'`]",
            rf"(?-i:{STRUCTURED.pattern})",
        ]
    ), re.I)
PLACEHOLDER = re.compile(
    r"^(?:change.?me|replace.?(?:me|this|with.*)?|todo|tbd|none|null|true|false|undefined|redacted|removed|hidden|secret|password|passw0rd|token|example.*|sample.*|dummy.*|test.?(?:token|password|secret|key)?|fake.*|your.*|my.?(?:password|secret|token).*|placeholder.*|insert.*here|enter.*here|not.?(?:set|a).*)$"
    r"|x{4,}|\*{3,}|\.{3,}|example|placeholder|change-?_?me|your[-_ ]|[-_ ]here\b|redacted|dummy|^(.)\1*$|^(?:0?123456789?0?|abc(?:def)?\d*)$", re.I)  # fmt: skip
REFERENCE = re.compile(r"\$\{|\$\(|\{\{|\}\}|^\$\w|^%\w+%$|%\(|^<|^\{.*\}$|^(?:ENC_REF|ENC|file|env|vault|secret|ssm|arn|kms|op|sops|https?|ref)[:(]|/run/secrets|^process\.env|^os\.|getenv|^@\w+@$|^!|^&|^\*", re.I)


def parts(name: str) -> list[str]:
    return [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def names_secret(name: str) -> bool:
    """Whether a name holds a credential rather than speaking of one."""
    p = [x for x in parts(name) if not x.isdigit()]
    if not p or p[-1] in SPEAKS_OF:
        return False
    return any(x in SECRET_PARTS for x in p) or any(a in KEY_OWNERS and b in ("key", "keys") for a, b in zip(p, p[1:]))


def bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def digest_like(value: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|sha\d+[:-].+", value, re.I))


def usable(value: str, named: bool) -> bool:
    """Whether a value can be a credential as it stands. `named`: its name says that it is one."""
    if len(value) < 6 or any(c.isspace() for c in value) or PLACEHOLDER.search(value) or REFERENCE.search(value):
        return False
    if ISSUED.match(value):
        return True
    if re.fullmatch(r"[A-Za-z0-9+/]{8,}={0,2}", value) and len(value) % 4 == 0 and value.endswith("="):
        try:
            inner = base64.b64decode(value).decode()
            if inner.isprintable() and (PLACEHOLDER.search(inner) or REFERENCE.search(inner)):
                return False
        except ValueError:
            pass
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if not named:
        return kinds >= 2 and bits(value) >= 3.0 and not digest_like(value)
    if re.fullmatch(r"[\d.,:-]+|[A-Za-z]+(?:[_. ][A-Za-z]+)*|(?:/[\w.-]+)+/?|[\w.-]+\(.*", value):
        return False
    return kinds >= 2 and bits(value) >= 2.2


def _literals(line: str):
    """(value, [(start, end) of its parts], where its first literal begins, where the search for its name begins) of
    string literals; literals joined on the line are one. A name stands between a literal and the one before it, or is
    that one."""
    held, before = None, 0
    for m in LITERAL.finditer(line):
        g = next(i for i in (1, 2, 3) if m.group(i) is not None)
        span = m.span(g)
        if held and re.fullmatch(r"\s*\+\s*|\s+", line[held[4] : m.start()]):
            held = (held[0] + m.group(g), [*held[1], span], held[2], held[3], m.end())
            continue
        if held:
            yield held[:4]
            before = held[1][0][0]
        held = (m.group(g), [span], m.start(), before, m.end())
    if held:
        yield held[:4]


def line_candidates(line: str, ext: str):
    """(key, value, spans, named) of what stands where a credential may, whatever the value."""
    comment = bool(re.match(r"\s*(?:#|//|/?\*|--|;|<!--)", line))
    found = []
    for m in URL.finditer(line):
        if not re.fullmatch(r"pass(?:word|wd)?|secret|pwd|token", m.group(1), re.I):
            found.append(("url", m.group(1), [m.span(1)], True))
    for m in SCHEME.finditer(line):
        inner = m.group(2)
        if m.group(1) == "Basic":
            try:
                plain = base64.b64decode(inner + "=" * (-len(inner) % 4)).decode()
            except ValueError:
                plain = ""
            if ":" not in plain or PLACEHOLDER.search(plain.split(":", 1)[1]) or REFERENCE.search(plain):
                continue
        elif not re.search(r"\d", inner) and not ISSUED.match(inner):
            continue
        found.append((m.group(1).lower(), inner, [m.span(2)], True))
    previous = ""
    for value, spans, at, since in _literals(line):
        m = NAME_BEFORE.search(line, since, at)
        key = previous if re.search(r"[\"'`]\s*(?:,|:|=>)\s*$", line[since:at]) else m.group(1) if m else ""
        previous = value
        if ext == "json" and not line[:at].strip():
            continue
        if names_secret(key):
            found.append((key, value, spans, True))
        elif STRUCTURED.fullmatch(value):
            found.append((key, value, spans, False))
    if ext in CONFIG - {"json"} or comment or ext in ("md", "txt", "rst"):
        for m in BARE.finditer(line):
            if ext in CONFIG or names_secret(m.group(1)):
                found.append((m.group(1), m.group(2), [m.span(2)], names_secret(m.group(1))))
    for m in PAIR.finditer(line):
        if names_secret(m.group(1)):
            found.append((m.group(1), m.group(2), [m.span(2)], True))
    if comment or ext in ("md", "txt", "rst"):
        for m in SPOKEN.finditer(line):
            value = m.group(2).rstrip(".!?")
            found.append((m.group(1).lower(), value, [(m.start(2), m.start(2) + len(value))], True))
    for m in STRUCTURED.finditer(line):
        found.append(("", m.group(1), [m.span(1)], False))
    return found


def candidates(path: str, text: str) -> list[tuple]:
    """(line number, key, value, first, last, kind) of a file's candidates; first and last are offsets in the text.
    A private key is one candidate at its opening line, if a body follows it."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    out, done = [], 0
    while m := HINT.search(text, done):
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.start())
        b = len(text) if b < 0 else b
        done = b
        line = text[a:b]
        key = PRIVATE.search(line)
        if key:
            begin = a + key.end()
            end = PRIVATE_END.search(text, begin)
            other = PRIVATE.search(text, begin)
            last = end.start() if end and not (other and other.start() < end.start()) else BODY.match(text, begin).end()
            body = re.sub(r"\\n|[\s\"'+\\]", "", text[begin:last])
            body = re.match(r"(?:[A-Za-z-]+:[^\n]*?)?([A-Za-z0-9/=]*)", body.replace("+", "")).group(1)
            if len(body) >= 40 and bits(body) > 4:
                out.append((text.count("\n", 0, a) + 1, "private key", text[begin:last], begin, last, "block"))
                done = max(done, last)
                continue
        number = text.count("\n", 0, a) + 1
        for name, value, spans, named in line_candidates(line, ext):
            if len(value) >= 6 and not any(c.isspace() for c in value):
                out.append((number, name, value, a + spans[0][0], a + spans[-1][1], "named" if named else "structured"))
    return out


def confirmed_form(value: str, named: bool) -> bool:
    """Whether a value has the form of a credential: one that its name calls so, or a structured one."""
    if not named:
        if not STRUCTURED.fullmatch(value) or re.search(r"^data:|^v?\d+\.", value):
            return False
        if not (ISSUED.match(value) or re.search(r"\d", value) and re.search(r"[A-Za-z]", value)):
            return False
    return usable(value, named)


def line_credentials(line: str, ext: str) -> list[tuple]:
    """The candidates of a line that have a credential's form, without those that overlap an earlier one."""
    out: list[tuple] = []
    for key, value, spans, named in line_candidates(line, ext):
        if confirmed_form(value, named) and not any(a < spans[-1][1] and spans[0][0] < b for _, _, ss, _ in out for a, b in ss):
            out.append((key, value, spans, named))
    return out


def redact(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text with the credential in each range masked. Line ends, quotes and what joins literals stay, and so does
    every character that the syntax around could need; letters and digits become x, other signs of the credential -."""
    out, at = [], 0
    for a, b in sorted(ranges):
        a = max(a, at)
        if a >= b:
            continue
        out.append(text[at:a])
        out.append(re.sub(r"\\.|(?<=[\"'`])\s*\+?\s*(?=[\"'`])|[\"'`\s\\]|[A-Za-z0-9]|.", lambda m: m.group() if m.group()[0] in "\\\"'` \t\r\n+" and not m.group() == "+" else "x" if m.group().isalnum() else "-", text[a:b]))
        at = b
    return "".join(out) + text[at:]


_LOOK = "file_version_id string, repo string, path string, line_no int, name string, value string, first int, last int, kind string"


def _index(evidence: DataFrame, owners: int):
    """(files, seen, hits, index). seen: what stands where a credential may; hits: the automaton's matches of all these
    values in all files; index: value, named, names, repos, shared, form."""
    ship(evidence.sparkSession)
    files = evidence.where("unit_type = 'file' and file_version_id is not null").select(
        "file_version_id", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("content", F.lit("")).alias("content"))

    def look(frames):
        for f in frames:
            rows = [(i, r, p, *c) for i, r, p, t in f[["file_version_id", "repo", "path", "content"]].itertuples(index=False) for c in candidates(p, t)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _LOOK.split(", ")])

    seen = materialize(files.mapInPandas(look, _LOOK), "literals")
    values = seen.where("kind <> 'block'")
    whole = files.select(F.concat_ws("\x1f", "file_version_id", "path", "repo").alias("file"), "content")
    hits = materialize(scan(whole, "file", "content", values, "value", whole=True, lines=True), "occurrences")
    repos = hits.select("value", F.element_at(F.split("file", "\x1f"), 3).alias("repo")).groupBy("value").agg(F.approx_count_distinct("repo", 0.02).alias("repos"))
    index = values.groupBy("value").agg(F.approx_count_distinct(F.lower("name"), 0.02).alias("names"), F.max(F.col("kind") == "named").alias("named")).join(repos, "value", "left")

    @F.arrow_udf("boolean")
    def form(value, named):
        return pa.array([confirmed_form(v, n) for v, n in zip(value.to_pylist(), named.to_pylist())], pa.bool_())

    index = index.withColumn("shared", (F.col("names") >= owners) & (F.coalesce("repos", F.lit(0)) >= owners)).withColumn("form", form("value", "named"))
    return files, seen, hits, materialize(index, "values")


def find_secrets(evidence: DataFrame, owners: int = 5) -> tuple[DataFrame, DataFrame]:
    """(secrets, confirmed). secrets: file_version_id, path, line_no, first, last (offsets), kind of every credential
    in the `file` units; confirmed: value, names, repos.

    Every literal, setting, pair and part of an address that stands where a credential may, placeholders among them, is
    indexed over the corpus: the automaton looks for all these values in every file, so that the index counts the
    repositories of all their occurrences, and the distinct names that they are given. A value of `owners` names in
    `owners` repositories is a shared placeholder; a secret that is copied with its file keeps its name. The rest is
    confirmed if it is a structured value, or a named one of a credential's form and entropy (6 characters at least).
    As the automaton has scanned every file for the values already, a confirmed one is found wherever it stands, at no
    second pass. Private key blocks are found by their structure.

    Null content and paths count as empty; a credential that runs over lines counts at the line where it begins;
    repeated rows give one row; other columns are ignored."""
    _, seen, hits, index = _index(evidence, owners)
    confirmed = index.where("form and not shared").select("value", "names", "repos")
    spots = hits.join(confirmed.select("value"), "value", "left_semi").select(F.split("file", "\x1f").alias("f"), F.explode("spans").alias("s")).select(
        F.col("f")[0].alias("file_version_id"), F.col("f")[1].alias("path"), F.col("s.line").alias("line_no"), F.col("s.first").alias("first"), (F.col("s.last") + 1).alias("last"), F.lit("value").alias("kind"))
    own = seen.join(confirmed.select("value", "names"), "value", "left").where("kind = 'block' or names is not null")
    own = own.select("file_version_id", "path", "line_no", "first", "last", "kind")
    return own.unionByName(spots).distinct(), confirmed


def steps(evidence: DataFrame, owners: int = 5) -> DataFrame:
    """(step, n): values indexed, of these shared by too many owners, without a credential's form, confirmed; lines
    where a confirmed value stands as a candidate, lines that the automaton adds, lines of private keys."""
    _, seen, hits, index = _index(evidence, owners)
    counts = index.agg(F.count("*").alias("indexed"), F.count_if(F.col("shared")).alias("shared"), F.count_if(~F.col("shared") & ~F.col("form")).alias("no form"), F.count_if(F.col("form") & ~F.col("shared")).alias("confirmed"))
    confirmed = index.where("form and not shared").select("value")
    line = lambda df: df.select("file_version_id", "line_no").distinct()
    own = line(seen.where("kind <> 'block'").join(confirmed, "value", "left_semi"))
    all_lines = line(hits.join(confirmed, "value", "left_semi").select(F.split("file", "\x1f")[0].alias("file_version_id"), F.explode("spans.line").alias("line_no")))
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
    values = counts.select(F.explode(F.array(*(F.struct(F.lit(f"values {c}").alias("step"), F.col(c).alias("n")) for c in counts.columns))).alias("s")).select("s.*")
    return values.unionByName(one("lines of candidates", own)).unionByName(one("lines added by the automaton", all_lines.subtract(own))).unionByName(one("lines of private keys", line(seen.where("kind = 'block'"))))


def redacted(evidence: DataFrame, secrets: DataFrame) -> DataFrame:
    """(file_version_id, path, credentials, content): the files that hold credentials, with these masked."""
    files = evidence.where("unit_type = 'file'").select("file_version_id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    ranges = secrets.groupBy("file_version_id", "path").agg(F.collect_set(F.struct("first", "last")).alias("ranges"), F.countDistinct("line_no").alias("credentials"))

    @F.arrow_udf("string")
    def mask(text, spots):
        return pa.array([redact(t, [(s["first"], s["last"]) for s in ss]) for t, ss in zip(text.to_pylist(), spots.to_pylist())], pa.string())

    return files.dropDuplicates(["file_version_id", "path"]).join(ranges, ["file_version_id", "path"]).select("file_version_id", "path", "credentials", mask("content", "ranges").alias("content"))
