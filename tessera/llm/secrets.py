"""Secret scans through a trigram inverted index, in Spark SQL expressions.

From each rule's regular expression a Boolean query over trigrams is derived: an OR of
ANDs that every match must fulfil. The index holds, for each trigram that some rule asks
for, the distinct texts that contain it (in lower case, so that one index serves rules of
either case). Postings are intersected by adding up bits; the texts that are left are
verified by the regular expression itself. A rule without mandatory trigrams scans every
text. Texts are known by a 128-bit key: copies of a text are one entry of the index, and
only one of them, that with the smallest id, is verified.

Where candidates are few, as counted, they are broadcast to the documents; else both sides
are shuffled, and of the documents only those that stand in some posting. Spans come from the lengths of
the matches and of what lies between them, summed up by a window over each text's matches:
linear in their number. Results go back to the copies of a text by `with_sums`, so a text that
a third of all documents share isn't a hot key.

Defined results: a null text is an empty one, without spans; equal rows get equal rows;
empty tables give empty results; other columns are ignored. Offsets are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import BROADCAST_ROWS, stored, with_sums


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are the leftmost that don't overlap; those whose `group` is shorter than `least` are then dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False
    gate: str | None = None  # a pattern that some part of every text with a kept match fits


RULES = (
    # The contract's base rules. Runs of one class can be asked for in full
    # length at once, as a run that is too short holds no longer one.
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}"),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16, 0, True),
    Rule("hex", r"[0-9a-f]{32,}", 32, 0, True),
    # Further kinds with a public format.
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("git_token", r"gh[oprsu]_[A-Za-z0-9]{36,255}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live_key", r"[rs]k_live_[A-Za-z0-9]{16,255}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]{2,12}://[A-Za-z0-9._~%-]{1,64}:[A-Za-z0-9._~%!$&*+=-]{1,64}@"),
)

#: Strings that one stretch of a pattern may stand for, at most; beyond, the stretch is cut.
MOST = 64


def _literals(tree) -> list[set[str] | None]:
    """The pattern as a sequence of sets of strings; None where anything may stand."""
    out: list[set[str] | None] = []
    for op, arg in tree:
        if op is sre.LITERAL:
            out.append({chr(arg).lower()})
        elif op is sre.IN and all(o is sre.LITERAL or o is sre.RANGE and a[1] - a[0] < 8 for o, a in arg):
            chars = {chr(c).lower() for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1))}
            out.append(chars if len(chars) <= 8 else None)
        elif op is sre.SUBPATTERN:
            out.extend(_literals(arg[3]))
        elif op is sre.BRANCH:
            ways = [_whole(_literals(x)) for x in arg[1]]
            out.append(None if None in ways else set().union(*ways))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = arg
            inner = _literals(body)
            if (least, most) == (0, 1):
                way = _whole(inner)
                out.append(None if way is None else way | {""})
            elif least == most and least * len(inner) <= 8:
                out.extend(inner * least)
            else:
                out.extend([*(inner if least else []), None])
        elif op is not sre.AT:
            out.append(None)
    return out


def _whole(parts: list[set[str] | None]) -> set[str] | None:
    if None in parts or len(list(product(*parts))) > MOST:
        return None
    return {"".join(x) for x in product(*parts)}


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of trigrams that the lower-cased text of every match fulfils; [frozenset()] if nothing is mandatory."""
    clauses: list[list[frozenset[str]]] = []
    run: set[str] = {""}

    def close():
        if all(len(s) >= 3 for s in run):
            clauses.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run])

    for part in _literals(_parser.parse(pattern)):
        if part is None or len(run) * len(part) > MOST:
            close()
            run = {""} if part is None else part
        else:
            run = {a + b for a in run for b in part}
    close()
    ways = [frozenset()]
    for c in sorted(clauses, key=len):
        if len(ways) * len(c) <= MOST:  # without a clause the query is only wider
            ways = [a | b for a in ways for b in c]
    return sorted((w for w in set(ways) if not any(o < w for o in ways)), key=sorted)


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def marked(docs: DataFrame, trigrams: list[str], scanned: list[Rule], id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, k1, k2, grams, hits): for every document the asked trigrams that its text
    contains, and the kinds without mandatory trigrams that it matches. One pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *_key(text)).withColumn("low", F.lower("text"))
    some = lambda cases, kind: F.array_compact(F.array(*cases).cast(f"array<{kind}>"))
    grams = some([F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams], "string")
    hits = some([F.when(F.col("text").rlike(r.gate or r.pattern), F.lit(r.kind)) for r in scanned], "string")
    return rows.select("doc_id", "k1", "k2", grams.alias("grams"), hits.alias("hits"))


def postings(entries: DataFrame) -> DataFrame:
    """(trigram, k1, k2): the inverted lists of the trigrams asked for. entries: one row for each text."""
    return entries.select("k1", "k2", F.explode("grams").alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(k1, k2, kind): the texts that fulfil the query of each kind. Every AND is a row of bits, one for each of its trigrams."""
    spark = index.sparkSession
    rows = [(kind, n, t, 1 << i, (1 << len(way)) - 1) for kind, ways in queries.items() for n, way in enumerate(ways) for i, t in enumerate(sorted(way)[:62])]
    rows = [(k, n, t, b, min(full, (1 << 62) - 1)) for k, n, t, b, full in rows]
    asked = spark.createDataFrame(rows, "kind string, way int, trigram string, bit long, full long")
    met = index.join(F.broadcast(asked), "trigram").groupBy("k1", "k2", "kind", "way").agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full"))
    return met.where("bits = full").select("k1", "k2", "kind")


STEP = "array<struct<n:int,g:int,m:int,keep:boolean>>"


def steps(text: Column, n: int, rule: Rule) -> Column:
    """The rule's matches in order: lengths of what lies before each and of the match, and whether it is kept."""
    p = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    kept = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else found
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    out = F.zip_with(both, kept, lambda s, k: F.struct(F.lit(n).alias("n"), s.g.alias("g"), s.m.alias("m"), (F.length(k) >= rule.least).alias("keep")))
    return F.when(text.rlike(rule.gate or rule.pattern), out.cast(STEP)).otherwise(F.array().cast(STEP))


SPAN = "array<struct<s:int,n:int,e:int,kind:string>>"


def spans(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(k1, k2, c, spans): all matches in order of start and rule, for texts that have any. texts: k1, k2, c, text, kinds."""
    none = F.array().cast(STEP)
    every = F.concat(*[F.when(F.array_contains("kinds", r.kind), steps(F.col("text"), i, r)).otherwise(none) for i, r in enumerate(rules)])
    # Rows that agree in id and text all come here; the matches of one of them are enough.
    rows = texts.select("k1", "k2", "c", every.alias("x")).where(F.size("x") > 0).groupBy("k1", "k2", "c").agg(F.first("x").alias("x"))
    rows = rows.select("k1", "k2", "c", F.posexplode("x").alias("pos", "x")).select("k1", "k2", "c", "pos", "x.*")
    end = F.sum(F.col("g") + F.col("m")).over(W.partitionBy("k1", "k2", "n").orderBy("pos")).cast("int")
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("n") + 1)
    rows = rows.withColumn("e", end).where("keep").select("k1", "k2", "c", F.struct((F.col("e") - F.col("m")).alias("s"), "n", "e", kind.alias("kind")).alias("x"))
    return rows.groupBy("k1", "k2", "c").agg(F.sort_array(F.collect_list("x")).cast(SPAN).alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id and `spans`, an array of (s, n, e, kind) in order of start and rule."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {kind: ways for kind, ways in queries.items() if all(ways)}
    scanned = [r for r in rules if r.kind not in asked]
    trigrams = sorted({t for ways in asked.values() for w in ways for t in w})
    rows = stored(marked(docs, trigrams, scanned, id_col, text_col))
    some = rows.where((F.size("grams") > 0) | (F.size("hits") > 0))
    entries = stored(some.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("one"), F.first("grams").alias("grams"), F.first("hits").alias("hits")))
    fit = entries.select("k1", "k2", F.explode("hits").alias("kind"))
    if asked:
        fit = fit.unionAll(candidates(postings(entries), asked))
    fit = fit.groupBy("k1", "k2").agg(F.collect_set("kind").alias("kinds"))
    found = stored(entries.select("k1", "k2", "c", "one").join(fit, ["k1", "k2"]))
    few = found.count() <= BROADCAST_ROWS // 8  # kinds and counts besides the keys
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *_key(text))
    if not few:
        texts = texts.where(reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(t)) for t in trigrams] + [F.col("text").rlike(r.gate or r.pattern) for r in scanned], F.lit(False)))
    asked_for = found.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "c", "one", "kinds")
    same = (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & F.col("doc_id").eqNullSafe(F.col("one"))
    verified = stored(spans(texts.join(F.broadcast(asked_for) if few else asked_for, same), rules))
    rows = rows.select("doc_id", "k1", "k2")
    size = verified.agg(F.coalesce(F.sum(F.size("spans") + 4), F.lit(0))).first()[0]
    if size <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(verified), ["k1", "k2"], "left")
    else:
        rows = with_sums(rows, verified, ["k1", "k2"], "c", rows.count(), "left")
    return rows.select("doc_id", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")


def check_patterns(rules: tuple[Rule, ...] = RULES) -> None:
    """Every pattern must be one that both the deriver's parser and Spark read."""
    for r in rules:
        re.compile(r.pattern)
