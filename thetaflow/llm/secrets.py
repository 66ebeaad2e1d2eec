"""Secret scan by a trigram inverted index.

Every rule is a regular expression.  From its parse tree a Boolean query on
lower-cased trigrams is derived: literals that any match must contain are
conjunctions of their trigrams, alternatives are disjunctions.  Rules without
such trigrams (a run of hexadecimal digits, say) scan every text.

The index is a table of postings (trigram, document).  For a fixed set of
rules only trigrams that some rule asks for are posted: other lists would
never be read.  ``postings(docs)`` without rules gives the full index.  Lists are
intersected by gathering the rules' trigrams that each document has and
testing each clause on them.  Candidates are joined to their texts, and the expressions are
run on them to find the spans.

Only DataFrame functions are used.  Documents are identified by id and a
128-bit hash of the text, so a group of copies, or of one id, is never one key.

Defined results: a null text counts as empty and has no spans; equal rows (id and text)
give one row; rows without id are kept apart by their texts; an empty table
gives an empty one; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and not overlapping, of
    which group ``group`` has ``least`` characters or more.  The pattern must
    mean the same to Java and, for its trigrams, to Python."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed patterns and lengths.  A run of one class has its least length in the pattern: the leftmost match starts where
#: the run does, so this finds the same spans as dropping short runs, without listing them.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds of the same method.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

_SPANS = "array<struct<start:int,order:int,kind:string,end:int,text:string>>"

#: Clauses of a rule; a part of the pattern that would give more is taken as unknown text.
MOST_CLAUSES = 16


# --------------------------------------------------- trigram queries from rules

def clauses(pattern: str) -> list[frozenset[str]]:
    """The rule's query: any match contains all trigrams of at least one clause.

    An empty clause means that a match need not contain any trigram.
    """
    found = []
    for text in _required(sre.parse(pattern)):
        grams = {piece[i:i + 3] for piece in text for i in range(len(piece) - 2)}
        found.append(frozenset(grams))
    # a clause that asks for more than another one adds nothing to it
    least = [c for c in set(found) if not any(d < c for d in found)]
    return [frozenset()] if frozenset() in least else sorted(least, key=sorted)


def _required(tree) -> list[tuple[str, ...]]:
    """Alternatives of the lower-cased literal pieces that every match contains.

    The last piece of an alternative is still open: what follows extends it.
    """
    out: list[tuple[str, ...]] = [("",)]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts = [(chr(arg).lower(),)]
        elif name == "SUBPATTERN":
            parts = _required(arg[-1])
        elif name == "BRANCH":
            parts = [p for branch in arg[1] for p in _required(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            if (least, most) == (0, 1):
                parts = [("",)] + _required(inner)
            elif least:
                once = _required(inner)
                parts = once if (least, most) == (1, 1) else [p + ("",) if len(p) > 1 or p[0] else ("", "") for p in once]
                if least > 1:
                    parts = [("",) + p for p in parts]
            else:
                parts = [("", "")]
        elif name == "IN" and len(arg) <= 8 and all(str(a[0]) == "LITERAL" for a in arg):
            parts = [(c,) for c in sorted({chr(a[1]).lower() for a in arg})]
        elif name == "AT":
            parts = [("",)]
        else:
            parts = [("", "")]
        if len(out) * len(parts) > MOST_CLAUSES:
            parts = [("", "")]
        out = [a[:-1] + (a[-1] + b[0],) + b[1:] for a in out for b in parts]
    return out


def indexed(rules: tuple[Rule, ...]) -> dict[str, list[frozenset[str]]]:
    """kind -> clauses, of rules that have mandatory trigrams."""
    queries = {r.kind: clauses(r.pattern) for r in rules}
    return {kind: q for kind, q in queries.items() if frozenset() not in q}


# ------------------------------------------------------------------------ index

def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("key"), text.alias("text"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """(gram, id, key) for documents (id, key, text): all trigrams, or those that the rules ask for."""
    if rules is None:
        grams = F.array_distinct(F.regexp_extract_all("low", F.lit("(?s)(?=(...))"), F.lit(1)))
    else:
        wanted = sorted({g for q in indexed(rules).values() for c in q for g in c})
        grams = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in wanted]))
    return docs.select("id", "key", F.lower("text").alias("low")).select("id", "key", F.explode(grams).alias("gram"))


def candidates(lists: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, key, kinds): documents that fulfil the trigram query of a rule."""
    queries = indexed(rules)
    wanted = sorted({g for q in queries.values() for c in q for g in c})

    def fulfilled(q: list[frozenset[str]]) -> Column:
        return F.array_contains(F.array(*[
            F.size(F.array_except(F.array(*[F.lit(g) for g in sorted(c)]), "grams")) == 0 for c in q]), True)

    kinds = F.array_compact(F.array(*[F.when(fulfilled(q), F.lit(kind)) for kind, q in queries.items()]))
    return (lists.where(F.col("gram").isin(wanted)).groupBy("id", "key")
            .agg(F.collect_set("gram").alias("grams"))  # the rules' trigrams at most
            .select("id", "key", kinds.alias("kinds")).where(F.size("kinds") > 0))


# ----------------------------------------------------------------- verification

def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, kind, end>> of a rule's matches in a text, in code points.

    The matches and the texts between them, split at the same places, give the positions by their lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    lengths = F.transform(F.arrays_zip(between.alias("b"), matches.alias("m")),
                          lambda x: F.struct(F.length(x["b"]).alias("b"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("m"),
                                             x["m"].alias("text")))
    walk = F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found")),
        lambda s, x: F.struct(
            (s["at"] + x["b"] + x["m"]).alias("at"),
            F.when(x["text"].isNull(), s["found"]).otherwise(F.concat(s["found"], F.array(F.struct(
                (s["at"] + x["b"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"),
                (s["at"] + x["b"] + x["m"]).alias("end"), x["text"].alias("text"))))).alias("found")),
        lambda s: s["found"])
    long_enough = F.filter(walk, lambda x: F.length(
        F.regexp_extract(x["text"], rule.pattern, rule.group) if rule.group else x["text"]) >= rule.least)
    return F.when(F.exists(matches, lambda m: F.length(m) >= rule.least), long_enough).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, spans) for every distinct (id, text); spans are (start, order of the kind, kind, end, text), sorted."""
    docs = keyed(docs, id_col, text_col)
    query = indexed(rules)
    order = {r.kind: i for i, r in enumerate(rules)}
    full = [r for r in rules if r.kind not in query]
    none = F.array().cast(_SPANS)
    every = docs.select("id", "key", F.concat(none, *[spans_of(F.col("text"), r, order[r.kind]) for r in full]).alias("spans"))
    found = candidates(postings(docs, rules), rules)
    hits = docs.alias("d").join(found.alias("c"), (F.col("d.key") == F.col("c.key")) & F.col("d.id").eqNullSafe(F.col("c.id")))
    checked = hits.select("d.id", "d.key", F.concat(none, *[
        F.when(F.array_contains("c.kinds", r.kind), spans_of(F.col("d.text"), r, order[r.kind])).otherwise(none)
        for r in rules if r.kind in query]).alias("spans"))
    return every.unionAll(checked).groupBy("id", "key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of query ``op1_secrets``."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["order"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return scan(docs, rules).select(
        F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
