"""Secret scans with DataFrame functions only: three fixed rules, and tokens that look random to two Markov models.

Places of matches come without a user function: splitting a text at a pattern gives what lies between the matches, so
running sums of the lengths of both give each start. The models are first-order character chains over ALPHABET, one of
random strings (what the rules caught), one of ordinary identifiers (other words of the distinct texts), counted in
the same pass over all texts; a token's score is the log-likelihood ratio of the two.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

# Fixed patterns of the three base rules, in the order in which spans are listed. Access and hex are written with the
# least length inside: a run of these characters matches as a whole or not at all.
RULES = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
LEAST_VALUE = 6  # characters of an assigned value
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"  # tokens that the models judge
ORDINARY = r"[A-Za-z0-9+/_=-]{5,}"  # words that teach the model of ordinary identifiers
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RATIO = 0.4  # mean log-likelihood ratio per transition from which a token counts as random
MASK = "[REDACTED]"
_SIZE, _BLOCK, _PRIOR = len(ALPHABET), 256, 5.0


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _running(a: Column, total, join) -> Column:
    """total of each prefix of an array, in blocks, so that long arrays don't cost their square; join: of two totals."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, _BLOCK))

    def joined(bs: Column) -> Column:
        return _let(F.transform(bs, total), lambda ts: F.flatten(F.transform(bs, lambda x, b: _let(total(F.slice(ts, F.lit(1), b)), lambda before: F.transform(x, lambda y, i: join(before, total(F.slice(x, F.lit(1), i + 1))))))))

    return F.when(F.size(a) > 0, _let(blocks, joined)).otherwise(F.array().cast("array<long>"))


def running_sums(a: Column) -> Column:
    return _running(a, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y), lambda s, t: s + t)


def running_max(a: Column) -> Column:
    return _running(a, F.array_max, F.greatest)  # greatest passes over the null of no blocks before


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, found>> of a pattern's matches, leftmost and not overlapping; found is what the group has."""
    p = F.lit(pattern)
    whole, inside = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))

    def located(m: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x: F.length(x))
        steps = _let(gaps, lambda g: F.transform(g, lambda x, i: (x + F.when(i > 0, F.length(F.element_at(m, F.greatest(i, F.lit(1))))).otherwise(0)).cast("long")))
        return _let(steps, lambda s: F.arrays_zip(running_sums(s).alias("start"), m.alias("m"), inside.alias("found")))

    spans = F.transform(_let(whole, located), lambda x: F.struct(x["start"].cast("long").alias("start"), (x["start"] + F.length(x["m"])).cast("long").alias("end"), x["found"].alias("found")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")
    return F.when(F.regexp_like(text, p), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<struct<start, place, end, kind, found>> of the three rules, by start, then kind as listed."""

    def kind(i: int, name: str) -> Column:
        found = matches(text, RULES[name], 2 if name == "assign" else 0)
        if name == "assign":
            found = F.filter(found, lambda x: F.length(x["found"]) >= LEAST_VALUE)
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("place"), x["end"].alias("end"), F.lit(name).alias("kind"), x["found"].alias("found")))

    return F.array_sort(F.concat(*[kind(i, name) for i, name in enumerate(RULES)]))


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of transitions, random over ordinary, at (place of the first + 1) * _SIZE + place of the second.

    `docs` has t. Random strings are what the rules caught in any row; ordinary identifiers are the words of each
    distinct text, without what the rules caught there. Words are counted before their transitions. At most 2 x 67 x 67
    counts come to the driver. With no samples both models are uniform and nothing is random.
    """
    texts = docs.groupBy("t").agg(F.count(F.lit(1)).alias("n")).select("t", "n", base_spans(F.col("t")).alias("base"))
    plain = F.aggregate(F.expr("transform(base, x -> x.found)"), F.col("t"), lambda s, x: F.replace(s, x, F.lit(" ")))
    ordinary = F.transform(F.regexp_extract_all(plain, F.lit(ORDINARY), F.lit(0)), lambda w: F.struct(F.lit(0).alias("random"), w.alias("w"), F.lit(1).cast("long").alias("n")))
    secret = F.transform("base", lambda x: F.struct(F.lit(1).alias("random"), x["found"].alias("w"), F.col("n").alias("n")))
    words = texts.select(F.explode(F.concat(ordinary, secret)).alias("x")).groupBy("x.random", "x.w").agg(F.sum("x.n").alias("n"))
    words = words.filter((F.col("random") == 1) | ~F.regexp_like("w", F.lit(CANDIDATE)))  # what is to be judged isn't a sample
    pairs = words.filter("length(w) > 1").select("random", "n", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("pair"))
    counts: list[dict] = [{}, {}]
    for r in pairs.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect():
        if all(c in ALPHABET for c in r["pair"]):
            counts[r["random"]][r["pair"]] = r["n"]
    if not all(counts):
        return [0.0] * (_SIZE * _SIZE)
    firsts = [{a: sum(c.get(a + b, 0) for b in ALPHABET) for a in ALPHABET} for c in counts]
    seconds = [{b: sum(c.get(a + b, 0) for a in ALPHABET) for b in ALPHABET} for c in counts]
    alone = lambda k, b: (seconds[k][b] + 0.5) / (sum(seconds[k].values()) + 0.5 * _SIZE)
    # a transition that was rarely seen counts by how often its second character comes at all
    share = lambda k, a, b: (counts[k].get(a + b, 0) + _PRIOR * alone(k, b)) / (firsts[k][a] + _PRIOR)
    return [log(share(1, a, b) / share(0, a, b)) for a in ALPHABET for b in ALPHABET]


def score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio over the token's transitions."""
    literal = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda s, i: s + literal[place(i) * _SIZE + place(i + 1)])
    return total / (F.length(token) - 1)


def find_secrets(docs: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """Each row of docs (text, others) as the struct column `doc`, with `spans` array<struct<start, place, end, kind, found>>.

    Kinds are those of RULES and "random", a CANDIDATE that overlaps no span of the rules and scores `least` or more.
    Spans are in code points, end exclusive, by start, then kind as listed. Null text is empty; rows without secrets
    have an empty array; repeated rows come back each; empty table: no rows.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text_or_empty().alias("t"))
    scanned = d.select("doc", "t", base_spans(F.col("t")).alias("base"))
    ratios = train(d)
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = F.filter(matches(F.col("t"), CANDIDATE), lambda x: apart(x) & (score(x["found"], ratios) >= least))
    more = F.transform(more, lambda x: F.struct(x["start"].alias("start"), F.lit(len(RULES)).alias("place"), x["end"].alias("end"), F.lit("random").alias("kind"), x["found"].alias("found")))
    return scanned.select("doc", "t", "base", more.alias("more")).select("doc", F.array_sort(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs (text, others) with what find_secrets finds replaced by MASK; n_chars, where there is such a column, follows.

    Spans that overlap are replaced as one. Null text stays null.
    """
    found = find_secrets(docs)
    found = found.withColumn("upto", running_max(F.transform("spans", lambda x: x["end"])))
    t = F.col("doc.text")
    before = lambda i: F.coalesce(F.get("upto", i - 1), F.lit(0))
    piece = lambda x, i: _let(before(i), lambda done: F.when(x["start"] >= done, F.concat(F.substring(t, done + 1, x["start"] - done), F.lit(MASK))).otherwise(""))
    rest = F.substring(t, F.element_at("upto", -1) + 1, F.length(t))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", piece), ""), rest)).otherwise(t)
    out = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return found.withColumn("clean", clean).select(*[F.when(F.size("spans") > 0, out[c]).otherwise(F.col(f"doc.`{c}`")).alias(c) if c in out else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["place"] < len(RULES))
    count = lambda name: F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(F.col("doc.doc_id").alias("doc_id"), *map(count, RULES), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
