"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regex is parsed into a Boolean query over trigrams: the strings of its mandatory literal run give a
disjunction, and each string's trigrams a conjunction. The index holds postings of the trigrams that some rule needs; postings are
intersected per alternative, and only documents that a rule's query admits are verified with that rule's regex.
A rule whose regex has no literal of three characters scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _parser as re_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Alternatives that one literal run may branch into before it is cut.
MOST_ALTERNATIVES = 32


def literal_runs(regex: str) -> tuple[list[set[str]], bool]:
    """Sets of strings, one of each set being in every match of regex; and whether letters count in either case.

    Literals, small character classes, groups, alternations and optional parts extend a run by all their
    strings; anything else ends it.
    """
    ops = re_parser
    folded = False

    def strings(node) -> set[str] | None:
        """All strings that a node matches, or None if they are too many."""
        nonlocal folded
        kind, value = node
        if kind is ops.LITERAL:
            return {chr(value)}
        if kind is ops.IN:
            if all(k is ops.LITERAL for k, _ in value):
                return {chr(v) for _, v in value}
            return None
        if kind is ops.SUBPATTERN:
            folded |= bool(value[1] & re.IGNORECASE)
            return joined(value[3])
        if kind is ops.BRANCH:
            parts = [joined(x) for x in value[1]]
            return None if None in parts else set().union(*parts)
        if kind in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[1] <= 2:
            once = joined(value[2])
            if once is None:
                return None
            return set().union(*({"".join(x) for x in product(once, repeat=n)} for n in range(value[0], value[1] + 1)))
        return None

    def joined(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            more = strings(node)
            if more is None or len(out) * len(more) > MOST_ALTERNATIVES:
                return None
            out = {a + b for a in out for b in more}
        return out

    runs: list[set[str]] = []
    now = {""}
    for node in re_parser.parse(regex):
        more = strings(node)
        if more is not None and len(now) * len(more) <= MOST_ALTERNATIVES:
            now = {a + b for a in now for b in more}
        else:
            runs.append(now)
            now = more if more is not None and len(more) <= MOST_ALTERNATIVES else {""}
    return [*runs, now], folded


@dataclass(frozen=True)
class Rule:
    """regex is a pattern that Java and Python read alike.

    group, least: matches count only if that group has so many characters.
    """

    kind: str
    regex: str
    group: int = 0
    least: int = 1

    @property
    def fold(self) -> bool:
        return literal_runs(self.regex)[1]

    def trigram_query(self) -> list[list[str]]:
        """A disjunction of conjunctions of trigrams that every match satisfies; empty if none is mandatory.

        Of the literal runs whose strings all have three characters, the one with the longest shortest string is taken.
        """
        runs = [r for r in literal_runs(self.regex)[0] if min(map(len, r)) >= 3]
        if not runs:
            return []
        best = max(runs, key=lambda r: (min(map(len, r)), -len(r)))
        if self.fold:
            best = {x.lower() for x in best}
        found = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in best}
        return sorted(sorted(q) for q in found if not any(other < q for other in found))


#: The three base rules, in their listed order.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # equal to matching [0-9a-f]+ and dropping what is shorter than 16
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

#: Publicly documented credential formats beyond the base.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def _vocabulary(rules: tuple[Rule, ...]) -> dict[bool, list[str]]:
    """Trigrams that some rule needs, by whether they count in either case."""
    return {
        fold: sorted({t for r in rules if r.fold == fold for q in r.trigram_query() for t in q})
        for fold in (False, True)
    }


def trigram_postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, fold, doc_id, key): the documents that hold each needed trigram, without repeats in a text.

    key is a hash of the text: rows that share a doc_id, or have none, are dealt by it.
    """
    needed = _vocabulary(rules)
    listed = {fold: F.array(*map(F.lit, needed[fold])).cast("array<string>") for fold in needed}
    # case is folded once a text: the lambda's variable is the folded text
    folded = F.transform(F.array(F.lower("text")), lambda low: F.filter(listed[True], lambda t: F.contains(low, t)))
    exact = F.filter(listed[False], lambda t: F.contains(F.col("text"), t))
    pair = lambda fold: lambda t: F.struct(t.alias("trigram"), F.lit(fold).alias("fold"))
    held = F.concat(F.transform(F.get(folded, F.lit(0)), pair(True)), F.transform(exact, pair(False)))
    return docs.select("doc_id", F.xxhash64("text").alias("key"), F.explode(held).alias("p")).select("p.trigram", "p.fold", "doc_id", "key")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, key, rules): for each document, the rules whose Boolean query its postings satisfy.

    The postings of a conjunction are intersected by counting: a document is in all of n postings lists if it
    has n distinct trigrams of the conjunction. Partial counts are made before the shuffle.
    """
    terms = [
        (rule.kind, f"{rule.kind}/{k}", len(q), t, rule.fold)
        for rule in rules
        for k, q in enumerate(rule.trigram_query())
        for t in q
    ]
    query = {}  # (fold, trigram) -> alternatives
    size, owner = {}, {}
    for kind, name, n, t, fold in terms:
        query.setdefault((fold, t), []).append(name)
        size[name], owner[name] = n, kind
    names = sorted(size)
    # one bit mask a term: the places of the term in every alternative
    bit = {}
    for name in names:
        for fold, t in sorted(k for k, v in query.items() if name in v):
            bit[name, fold, t] = len([1 for key in bit if key[0] == name])
    masks = []
    for name in names:
        mask = F.lit(0)
        for (who, fold, t), place in bit.items():
            if who == name:
                mask = F.when((F.col("trigram") == t) & (F.col("fold") == F.lit(fold)), F.lit(1 << place)).otherwise(mask)
        masks.append(F.bit_or(mask).alias(name))
    found = postings.groupBy("doc_id", "key").agg(*masks)
    admitted = []
    for rule in rules:
        own = [n for n in names if owner[n] == rule.kind]
        if own:
            full = reduce(lambda a, b: a | b, [F.col(f"`{n}`") == F.lit((1 << size[n]) - 1) for n in own])
            admitted.append(F.when(full, F.lit(rule.kind)))
    return found.select("doc_id", "key", F.array_compact(F.array(*admitted)).alias("rules")).where(F.size("rules") > 0)


_NONE = "cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)"


def _spans(rule: Rule, order: int) -> Column:
    """array<struct<start, rank, end, kind>> of the rule's matches in text, in code points, end exclusive.

    The pieces between matches and the matches themselves are cut by one pattern, so their lengths add up to places.
    """
    matches = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0))
    checked = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group)) if rule.group else matches
    gaps = F.split("text", rule.regex, -1)
    rows = F.arrays_zip(
        F.transform(gaps, lambda g: F.length(g)).alias("gap"),
        F.transform(matches, lambda m: F.length(m)).alias("size"),
        F.transform(checked, lambda m: F.length(m)).alias("checked"),
    )
    taken = lambda r: r["gap"] + F.coalesce(r["size"], F.lit(0))

    def block(z: Column) -> Column:
        """Spans of one block of rows, which begins at z.ahead."""
        return F.aggregate(
            z["rows"],
            F.struct(z["ahead"].alias("at"), F.expr(_NONE).alias("found")),
            lambda s, r: F.struct(
                (s["at"] + taken(r)).alias("at"),
                F.when(
                    r["checked"] >= rule.least,
                    F.array_append(
                        s["found"],
                        F.struct(
                            (s["at"] + r["gap"]).alias("start"), F.lit(order).alias("rank"),
                            (s["at"] + r["gap"] + r["size"]).alias("end"), F.lit(rule.kind).alias("kind"),
                        ),
                    ),
                ).otherwise(s["found"]).alias("found"),
            ),
            lambda s: s["found"],
        )

    def places(rows: Column) -> Column:
        # an array grows by copying, so rows are taken in about as many blocks as a block has rows
        size = F.ceil(F.sqrt(F.size(rows))).cast("int")
        firsts = F.sequence(F.lit(1), F.size(rows), size)
        return _once(F.transform(firsts, lambda at: F.slice(rows, at, size)), spans)

    def spans(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda rows: F.aggregate(rows, F.lit(0), lambda n, r: n + taken(r)))
        ahead = F.aggregate(
            sums,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["all"], s["at"]).alias("all")),
            lambda s: s["all"],
        )
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("rows"), ahead.alias("ahead")), block))

    return _once(rows, places)


def _once(value: Column, then) -> Column:
    """then(value), with value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, column: str = "secret_spans") -> DataFrame:
    """docs with a column of secret spans: array<struct<start, rank, end, kind>> ordered by start, then rule.

    docs needs doc_id and text; a null text counts as empty. Its other columns stay. Rows are looked up by doc_id and a
    hash of their text, so those that repeat a doc_id or have none meet only equal texts.
    An empty table gives an empty one. A column of the same name is replaced.
    """
    found = candidates(trigram_postings(docs.select("doc_id", "text"), rules), rules)
    docs = docs.drop(column)
    id_name, key_name, rules_name = (free_name(f"secret_{n}", docs.columns) for n in ("id", "key", "rules"))
    found = found.select(F.col("doc_id").alias(id_name), F.col("key").alias(key_name), F.col("rules").alias(rules_name))
    same = F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.xxhash64("text") == F.col(key_name))
    joined = docs.join(found.hint("shuffle_hash"), same, "left")
    spans = []
    for order, rule in enumerate(rules):
        each = _spans(rule, order)
        if rule.trigram_query():
            each = F.when(F.array_contains(rules_name, rule.kind), each).otherwise(F.expr(_NONE))
        else:
            each = F.when(F.rlike("text", F.lit(rule.regex)), each).otherwise(F.expr(_NONE))
        spans.append(F.coalesce(each, F.expr(_NONE)))
    return joined.select(*docs.columns, F.array_sort(F.concat(*spans)).alias(column))


def span_report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of found (doc_id, secret_spans).

    Without spans, counts are 0, spans is empty and the digest that of nothing. Other columns are ignored.
    """
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda x: x["rank"] < len(BASE))
    return found.select(
        "doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(F.concat_ws(",", F.transform(base, name)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("secret_spans", name)).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with every span of text replaced by mark; overlapping spans become one. n_chars follows changed texts.

    Columns, their order and clean rows stay as they are; a null text stays null, repeated rows stay rows of their own
    and an empty table gives an empty one.
    """
    spans = free_name("secret_spans", docs.columns)
    found = secret_spans(docs, rules, spans)
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(s["out"], F.col("text").substr(s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
        lambda s: F.concat(s["out"], F.col("text").substr(s["at"] + 1, F.length("text"))),
    )
    hit = F.size(spans) > 0
    changed = found.withColumn("text", F.when(hit, step).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
