"""Secret scans: a trigram inverted index proposes the texts that a rule may match, and regular expressions verify them.

DataFrame operations only. From each rule's regular expression a Boolean query over trigrams is derived: an AND of
clauses, a clause being an OR of sets of trigrams that must all occur. The index lists, for each trigram that some
query names, the documents whose lower-cased text holds it; a rule's candidates are the documents in the postings that
its query asks for. A rule without mandatory trigrams has no query and scans all texts.

Spans are in code points, end exclusive, leftmost and non-overlapping for each kind. Nulls and odd rows: a null text is
empty and has no spans; rows are indexed by a hash of doc_id and text, so a null doc_id is as good as any, and rows that
share a hash can only be each other's candidates, never have each other's spans; repeated rows stay; an empty table gives
an empty result; other columns are ignored.

Scale: a row's postings are one entry, so a frequent trigram makes no hot key and the index is as long as the rows that
hold some named trigram. The candidates that the index proposes are measured. Up to MOST_BROADCAST bytes they are
broadcast to the texts; beyond that the same query is asked of each text's own postings, beside the text. Either way no
text is shuffled.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read


@dataclass(frozen=True)
class Rule:
    """kind; regular expression; the group whose length counts and its least length; whether op3's base has it."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


# op3's base kinds, in the order in which its spans list them.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
)
#: What the scan finds besides: token formats that name their issuer, and private keys.
MORE = (
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("chat", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

#: A clause: sets of trigrams of which one must occur whole. A query: clauses that must all hold.
Clause = frozenset[frozenset[str]]

_MOST_STRINGS, _MOST_CLASS = 128, 16
MOST_BROADCAST = 16 << 20
_SPANS = "array<struct<start:long,rank:int,end:long,kind:string>>"


def _strings(node: tuple) -> set[str] | None:
    """The strings that a node matches, if they are few."""
    op, arg = node
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is rc.LITERAL:
                found.add(chr(value).lower())
            elif kind is rc.RANGE and value[1] - value[0] < _MOST_CLASS:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= _MOST_CLASS else None
    if op is rc.SUBPATTERN:
        return _product(arg[3])
    if op is rc.BRANCH:
        each = [_product(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op is rc.MAX_REPEAT and arg[1] != rc.MAXREPEAT and arg[1] <= 2:
        one = _product(arg[2])
        if one is not None:
            return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
    return None


def _product(nodes: object) -> set[str] | None:
    out = {""}
    for node in nodes:
        each = _strings(node)
        if each is None or len(out) * len(each) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in each}
    return out


def _clause(strings: set[str]) -> Clause | None:
    """What strings, one of which occurs, say about trigrams; None if nothing."""
    if not all(len(s) >= 3 for s in strings):
        return None
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return frozenset(x for x in sets if not any(y < x for y in sets))


def _clauses(nodes: object) -> list[Clause]:
    found: list[Clause | None] = []
    run = {""}
    for node in nodes:
        each = _strings(node)
        if each is not None and len(run) * len(each) <= _MOST_STRINGS:
            run = {a + b for a in run for b in each}
            continue
        found.append(_clause(run))
        run = {""}
        op, arg = node
        if each is not None:
            run = each
        elif op is rc.SUBPATTERN:
            found += _clauses(arg[3])
        elif op is rc.BRANCH:
            options = [_clauses(x) for x in arg[1]]
            if all(options):  # of an alternative, its first clause is enough
                found.append(frozenset().union(*(x[0] for x in options)))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
            found += _clauses(arg[2])
    return [x for x in [*found, _clause(run)] if x]


def query(regex: str) -> list[Clause]:
    """The Boolean trigram query that every match of the expression satisfies in lower case; empty: none is mandatory."""
    return list(dict.fromkeys(_clauses(rp.parse(regex))))


def held_in(text: Column, rules: tuple[Rule, ...]) -> Column:
    """A text's postings: those trigrams that it holds in lower case, of all that the rules' queries name."""
    names = sorted({t for r in rules for c in query(r.regex) for some in c for t in some})
    return let(F.lower(text), lambda folded: F.filter(F.array(*map(F.lit, names)), lambda t: F.contains(folded, t)))


def kinds_of(held: Column, rules: tuple[Rule, ...]) -> Column:
    """The kinds of rules whose queries a row's postings satisfy."""
    def holds(clause: Clause) -> Column:
        options = [F.size(F.array_except(F.array(*map(F.lit, sorted(some))), held)) == 0 for some in sorted(clause, key=sorted)]
        out = options[0]
        for x in options[1:]:
            out = out | x
        return out

    kinds = [F.lit(None).cast("string")]
    for rule in rules:
        if clauses := query(rule.regex):
            both = holds(clauses[0])
            for c in clauses[1:]:
                both = both & holds(c)
            kinds.append(F.when(both, F.lit(rule.kind)))
    return F.array_compact(F.array(*kinds))


def index(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rk and held, the postings of the rows that have any. rk is a hash of doc_id and text."""
    # An exploded array of one is worked out once, where a filter above would work it out again.
    return docs.select(F.xxhash64("doc_id", "text").alias("rk"), F.explode(F.array(held_in(F.col("text"), rules))).alias("held")).where(F.size("held") > 0)


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rk and the kinds of rules whose queries the postings satisfy, of rows with any."""
    return postings.select("rk", F.explode(F.array(kinds_of(F.col("held"), rules))).alias("kinds")).where(F.size("kinds") > 0)


def let(value: Column, use: object) -> Column:
    """use(value), where the value is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Matches as (start, rank, end, kind): what splitting by the expression leaves gives the places between.

    n matches are placed in blocks of sqrt(n), each from where it begins, so no array of all of them grows one by one.
    """
    # A maximal run is the only match it begins, so short ones needn't be split off one by one.
    regex = re_least(rule)
    pieces, whole = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    cuts = let(whole, lambda w: F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(w)), F.length).alias("piece"), F.transform(w, F.length).alias("whole"), long_enough.alias("ok")))

    def place(block: Column, at: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            begin = state["at"] + x["piece"]
            end = begin + x["whole"]
            span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            return F.struct(end.alias("at"), F.when(x["ok"], F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("found")), step, lambda s: s["found"])

    def begins(blocks: Column) -> Column:
        length = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda n, x: n + x["piece"] + x["whole"])
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("found"))
        return F.aggregate(blocks, start, lambda s, block: F.struct((s["at"] + length(block)).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found")), lambda s: s["found"])

    def placed(c: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(c))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(c) / side).cast("int") - 1), lambda b: F.slice(c, b * side + 1, side))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, begins(bs), place)))

    return F.when(F.regexp_like(text, F.lit(regex)), let(cuts, placed)).otherwise(F.array().cast(_SPANS))


def re_least(rule: Rule) -> str:
    """The expression, with the least length of a lone character run written into it."""
    if rule.group == 0 and rule.least > 1 and (m := rule.regex).endswith("]+"):
        fixed = len(m[: m.rindex("[")])
        return f"{m[:-1]}{{{rule.least - fixed},}}"
    return rule.regex


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and, for each rule, an array of its spans in a column of the kind's name."""
    prepare(docs.sparkSession)
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = candidates(index(narrow, rules), rules).groupBy("rk").agg(F.first("kinds").alias("kinds")).checkpoint()
    if (found.agg(F.sum(F.octet_length(F.array_join("kinds", " ")) + 64)).first()[0] or 0) <= MOST_BROADCAST:
        both = narrow.withColumn("own", F.xxhash64("doc_id", "text")).join(F.broadcast(found), F.col("own") == F.col("rk"), "left")
    else:
        own = let(held_in(F.col("text"), rules), lambda held: kinds_of(held, rules))
        both = narrow.select("*", F.explode(F.array(own)).alias("kinds"))
    columns = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, rank)
        if query(rule.regex):
            spans = F.when(F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), rule.kind), spans).otherwise(F.array().cast(_SPANS))
        columns.append(spans.alias(rule.kind))
    return both.select("doc_id", *columns)


def summary(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """op3's columns."""
    base = [r.kind for r in rules if r.base]
    found = scan(docs, rules)
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(listed(F.concat(*base)), 256).alias("base_sha256"), listed(F.concat(*[r.kind for r in rules])).alias("spans"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(read(spark, sf_dir, "documents"))


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _sql() -> str:
    words = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
    regexes = {r.kind: r.regex for r in RULES} | {"assign": f"""({words})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""}
    parts = []
    for rank, rule in enumerate(RULES):
        regex = regexes[rule.kind]
        parts.append(f"""
  select doc_id, text, {rank} as rank, '{rule.kind}' as kind, {'true' if rule.base else 'false'} as base, {rule.least} as least,
         unnest(string_split_regex(text, '{regex}')[:-2]) as piece, unnest(regexp_extract_all(text, '{regex}')) as whole,
         unnest(regexp_extract_all(text, '{regex}', {rule.group})) as part, unnest(range(len(regexp_extract_all(text, '{regex}')))) as i
  from docs where regexp_matches(text, '{regex}')""")
    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
cuts as ({' union all '.join(parts)}),
placed as (select *, sum(length(piece) + length(whole)) over (partition by doc_id, kind order by i) as stop from cuts),
spans as (select doc_id, rank, kind, base, stop::bigint as stop, (stop - length(whole))::bigint as start from placed where length(part) >= least),
lists as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (base) as b,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
  from spans group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join lists using (doc_id)"""


SQL = _sql()
