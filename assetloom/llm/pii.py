"""Personal data: exact base patterns, and contexts bootstrapped from what they find.

Only DataFrame functions are used. Base entities are found by regular expressions and checks. They are the seeds of a
bootstrap: the words before and after an entity are patterns, entities and look-alikes that no base pattern accepts are
instances, and the two sides score each other over a graph of pattern-instance links for some rounds. Look-alikes that
stand in contexts which otherwise hold one kind of entity are reported as that kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

KINDS = ("email", "ip", "card", "phone")
#: Rounds of the bootstrap; distinct instances that a pattern needs; confidence of a pattern and of a reported instance.
ROUNDS, SUPPORT, PATTERN, REPORT = 3, 5, 0.8, 0.9
#: Characters on either side in which the context words are looked for.
REACH = 40

# The separators inside an address or a number are first replaced by a character that texts keep free (it is mapped
# away beforehand), so that each expression is a plain run of characters: no nested repetition, whose depth or
# backtracking would grow with the text. All replacements keep every position.
_SEP, _FREE = "\u0001", "\u0002"
_LOCAL = rf"[A-Za-z0-9._%+{_SEP}-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++{_SEP}[A-Za-z0-9{_SEP}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{_SEP}])[0-9{_SEP}]{{14,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Look-alikes: something with an at-sign, or digits with the separators of numbers, not inside a word.
ALIKE = r"[^\s@]++@[^\s@]++|(?<![A-Za-z0-9+(])[+(]?[0-9][0-9().-]*+(?:\x20[0-9().-]++)*+(?![A-Za-z0-9])"


def located(text: Column, pattern: str) -> Column:
    """``start, end, value`` of all matches, from what lies between them: ends exclusive, in code points."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(hits.alias("h"), gaps.alias("g"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["h"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["h"].alias("value")))).alias("out"))
    # the last gap has no match after it
    return F.aggregate(F.filter(pairs, lambda x: x["h"].isNotNull()), begin, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def worth(x, i):
        d = x.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda s, d: s + d) % 10 == 0


def _checked(kind: str, spans: Column) -> Column:
    def good(x):
        v, n = x["value"], F.length(_digits(x["value"]))
        if kind == "ip":
            return v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
        if kind == "card":
            return F.when(n.between(14, 19), luhn(_digits(v))).otherwise(False)
        if kind == "phone":
            return n.between(10, 15)
        return F.lit(True)
    return F.transform(F.filter(spans, good), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, ordered by start, then kind: ``start, kind (number), end, value``."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    clean = F.translate(text, _SEP, _FREE)
    address = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _SEP)
    number = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", _SEP)
    parts = [F.when(F.contains(text, F.lit("@")), _checked("email", located(address, EMAIL))).otherwise(none),
             F.when(text.rlike(r"[0-9]\.[0-9]"), _checked("ip", located(text, IP))).otherwise(none),
             F.when(text.rlike("[0-9]"), _checked("card", located(number, CARD))).otherwise(none),
             F.when(F.contains(text, F.lit("+")), _checked("phone", located(text, PHONE))).otherwise(none)]
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _context(text: Column, x: Column) -> Column:
    """Patterns of a span: the word before and the word after it, with the class of what they surround."""
    kind = F.when(F.contains(x["value"], F.lit("@")), "at").otherwise("number")
    begin = F.greatest(x["start"] - REACH, F.lit(0))
    before = F.regexp_extract(F.lower(F.substr(text, begin + 1, x["start"] - begin)), r"(\S+)\s*$", 1)
    after = F.regexp_extract(F.lower(F.substr(text, x["end"] + 1, F.lit(REACH))), r"^\s*(\S+)", 1)
    both = F.array(F.when(before != "", F.concat_ws("\t", F.lit("<"), kind, before)), F.when(after != "", F.concat_ws("\t", F.lit(">"), kind, after)))
    return F.filter(both, lambda p: p.isNotNull())


def _instances(text: Column, base: Column) -> Column:
    """Base spans and look-alikes that touch none: ``start, end, kind (null for look-alikes), value, patterns``."""
    alike = F.when(text.rlike("[0-9@]"), F.filter(located(text, ALIKE), lambda x: (F.length(_digits(x["value"])) >= 7) | F.contains(x["value"], F.lit("@")))) \
        .otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    free = F.filter(alike, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))

    def shown(x, kind):
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.cast("int").alias("kind"), F.lower(x["value"]).alias("value"), _context(text, x).alias("patterns"))
    return F.concat(F.transform(base, lambda x: shown(x, x["kind"])), F.transform(free, lambda x: shown(x, F.lit(None))))


def bootstrap(instances: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, pattern: float = PATTERN) -> DataFrame:
    """``value, kind, score`` of look-alikes, from rows of ``value, kind, patterns``.

    Each round: the confidence of a pattern for a kind is the mean score of its distinct instances (base entities score
    1 for their kind), if it has at least ``support`` of them; the score of a look-alike is one minus the product of the
    doubts of its patterns with at least ``pattern`` confidence. A pattern seen very often is summed before the shuffle.
    """
    # rows, never arrays: a value may stand in any number of contexts; one without a context still tells its kind
    seen = written(instances.select("value", "kind", F.explode_outer("patterns").alias("pattern")).distinct(), "instances")
    known = seen.groupBy("value").agg(F.max("kind").alias("kind"))
    links = written(seen.where("pattern is not null").select("value", "pattern").distinct().join(known, "value").select("value", "kind", "pattern"), "pattern-links")
    kinds = F.explode(F.array(*[F.lit(i) for i in range(len(KINDS))]))
    count = links.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    seeds = links.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("known"))
    fixed = written(count.select("pattern", "n", kinds.alias("k")).join(seeds.withColumnsRenamed({"kind": "k"}), ["pattern", "k"], "left")
                    .select("pattern", "k", "n", F.coalesce("known", F.lit(0)).alias("known")), "patterns")
    open_ = links.where("kind is null").select("value", "pattern")
    found = None
    for _ in range(rounds):
        if found is None:
            conf = fixed.select("pattern", "k", (F.col("known") / F.col("n")).alias("c"))
        else:
            gained = open_.join(found, "value").groupBy("pattern", "k").agg(F.sum("score").alias("gain"))
            conf = fixed.join(gained, ["pattern", "k"], "left").select("pattern", "k", ((F.col("known") + F.coalesce("gain", F.lit(0.0))) / F.col("n")).alias("c"))
        sure = conf.where(F.col("c") >= pattern)
        found = written(open_.join(sure, "pattern").groupBy("value", "k")
                        .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-6)))))).alias("score")), "scores")
    best = found.groupBy("value").agg(F.max(F.struct("score", -F.col("k"))).alias("b"))
    return best.select("value", (-F.col("b")["col2"]).alias("kind"), F.col("b")["score"].alias("score"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", report: float = REPORT) -> DataFrame:
    """``uid``, ``doc_id``, ``base`` and ``spans`` (arrays of ``start, kind, end``) for every row.

    ``spans`` are the base spans and the reported look-alikes, ordered by start, then kind. Null text counts as empty;
    a null id stays null; repeated rows get equal spans. Texts are read whole; the work per character is constant but
    for texts with very many entities, whose lists are built one by one. An empty table gives an empty result.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    based = rows.select("uid", "doc_id", whole.alias("text"), base_spans(whole).alias("b"))
    table = written(based.select("uid", "doc_id", F.transform("b", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias("base"),
                                 _instances(F.col("text"), F.col("b")).alias("instances")), "entities")
    each = table.select("uid", F.explode("instances").alias("x")).select("uid", "x.*")
    scores = bootstrap(each.select("value", "kind", "patterns")).where(F.col("score") >= report).select("value", F.col("kind").alias("k"))
    extra = (each.where("kind is null").join(scores, "value").groupBy("uid")
             .agg(F.collect_list(F.struct("start", F.col("k").alias("kind"), "end")).alias("extra")))
    return (table.join(extra, "uid", "left")
            .select("uid", "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans")))
