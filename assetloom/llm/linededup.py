"""Line dedup: repeated runs of lines, found by prefix doubling over line ids, lose their later copies.

Only DataFrame functions are used. Lines are named by a 128-bit digest of their text. Suffixes whose first line occurs
once cannot start a repeated run and are discarded at once, so that the doubling works on the repeated lines alone:
round a names every run of 2**a lines by the pair of names of its halves. Runs of equal name are one interval of
suffixes with a common prefix of that many lines, and a run of any length h is named by two overlapping runs of
2**floor(log2 h) lines. The earliest member of an interval stays, the others are later copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .common import field, numbered, restored

#: Shortest repeated run, in words, that is boilerplate and not chance.
MIN_WORDS = 20
WORD = r"[^\x20\x09-\x0D]+"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _levels(runs: DataFrame, rounds: int) -> DataFrame:
    """``names`` and ``sums``: per round a, name and number of words of the 2**a lines from each position."""
    df = runs.withColumns({"n0": F.transform("ls", lambda x: x["h"]), "s0": F.transform("ls", lambda x: x["w"])})
    for a in range(rounds):
        half, last = 2 ** a, F.col("n") - 2 ** (a + 1)
        at = F.sequence(F.lit(0), last)
        df = df.withColumns({
            f"n{a + 1}": F.when(last >= 0, F.transform(at, lambda k: F.unhex(F.md5(F.concat(F.col(f"n{a}")[k], F.col(f"n{a}")[k + half])))))
            .otherwise(F.array().cast("array<binary>")),
            f"s{a + 1}": F.when(last >= 0, F.transform(at, lambda k: F.col(f"s{a}")[k] + F.col(f"s{a}")[k + half]))
            .otherwise(F.array().cast("array<int>")),
        })
    return df


def _short_of(df: DataFrame, rounds: int, min_words: int, forward: bool) -> Column:
    """Per position, the largest number of lines from (or up to) it that hold fewer than ``min_words`` words.

    Goes down the rounds: a step of 2**a lines is taken wherever it fits and stays short of the words.
    """
    def longer(a: int):
        step = 2 ** a

        def move(x, k):
            start = k + x["o"] if forward else k - x["o"] - step + 1
            fits = start + step <= F.col("n") if forward else start >= 0
            words = x["s"] + F.col(f"s{a}")[start]
            return F.when(fits, F.when(words < min_words, F.struct((x["o"] + step).alias("o"), words.alias("s"))).otherwise(x)).otherwise(x)
        return move

    state = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda _: F.struct(F.lit(0).alias("o"), F.lit(0).alias("s")))
    for a in range(rounds, -1, -1):
        state = F.transform(state, longer(a))
    return F.transform(state, lambda x: x["o"])


def repeated_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``uid`` and ``gone``: the lines (from 0) of each row that belong to a later copy of a repeated run.

    ``rows`` has ``uid``, ``doc_id`` and ``text``. A line goes if some run of consecutive lines of its document that
    contains it, holds at least ``min_words`` words and equals a run that starts earlier: in a smaller ``doc_id``
    (nulls last; ties by text hash, then uid) or further up in the same document. It is enough to look at the
    shortest such run from each position and up to each position: a longer run is covered by those inside it.
    """
    lines = rows.select("uid", "doc_id", F.xxhash64("text").alias("th"), F.posexplode(split_lines(F.col("text"))).alias("i", "line")) \
        .select("uid", "doc_id", "th", "i", F.unhex(F.md5("line")).alias("h"), F.regexp_count("line", F.lit(WORD)).alias("w"))
    # written, so that the join below is between plain shuffles, which AQE splits where a line is very common
    twice = written(lines.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "lines")
    alive = lines.join(twice, "h")
    in_doc = Window.partitionBy("uid").orderBy("i")
    runs = written(alive.withColumn("seg", F.col("i") - F.row_number().over(in_doc))
            .groupBy("uid", "seg").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.min("i").alias("i0"), F.sum("w").alias("words"),
                                       F.sort_array(F.collect_list(F.struct("i", "h", "w"))).alias("ls"))
            .where(F.col("words") >= min_words).withColumn("n", F.size("ls")), "runs")
    # A short run has at most min_words lines with words; only blank lines can make it longer.
    longest = runs.agg(F.max("n")).first()[0] or 1
    rounds = int(longest).bit_length() - 1
    df = _levels(runs, rounds)
    df = df.withColumns({"fw": _short_of(df, rounds, min_words, True), "bw": _short_of(df, rounds, min_words, False),
                         "names": F.array(*[F.col(f"n{a}") for a in range(rounds + 1)])})
    ahead = F.transform("fw", lambda o, k: F.when(k + o < F.col("n"), F.struct(k.alias("k"), (o + 1).alias("len"))))
    behind = F.transform("bw", lambda o, k: F.when(k - o >= 0, F.struct((k - o).alias("k"), (o + 1).alias("len"))))
    both = F.array_distinct(F.filter(F.concat(ahead, behind), lambda x: x.isNotNull()))
    power = F.floor(F.log2(F.col("x.len").cast("double") + 0.5)).cast("int")
    name = F.md5(F.concat(F.col("x.len").cast("string").cast("binary"), F.col("names")[power][F.col("x.k")],
                          F.col("names")[power][F.col("x.k") + F.col("x.len") - F.pow(F.lit(2.0), power).cast("int")]))
    windows = written(df.select("uid", "doc_id", "th", "i0", "names", F.explode(both).alias("x"))
               .select("uid", F.unhex(name).alias("name"), (F.col("i0") + F.col("x.k")).alias("start"), F.col("x.len").alias("len"),
                       F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "uid", (F.col("i0") + F.col("x.k")).alias("i")).alias("at")), "windows")
    first = written(windows.groupBy("name").agg(F.min("at").alias("first"), F.count("*").alias("c")).where("c > 1").select("name", "first"), "first")
    later = windows.join(first, "name").where("at > first")
    return (later.groupBy("uid").agg(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("r"))
            .select("uid", F.array_sort(F.array_distinct(F.flatten("r"))).alias("gone")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``uid``, ``row`` (all columns), ``n_lines``, ``gone`` and ``kept_text`` for every row of ``docs``.

    A line is what stands between newlines; equal lines are equal to the character. Null text: no lines, ``kept_text``
    null. Empty text: one empty line, which holds no words and stays. A document without deleted lines keeps its text
    as it is; one whose lines all go has ``kept_text`` ''. Repeated rows are told apart by their row number: the first
    keeps its lines. Very long texts are one array of line digests in one row. An empty table gives an empty result.
    """
    rows = numbered(docs, "documents")
    gone = repeated_lines(rows.select("uid", field("row", doc_id).alias("doc_id"), field("row", text).alias("text")), min_words)
    lines = split_lines(field("row", text))
    n = F.coalesce(F.size(lines), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: lines[i])
    # the lists of deleted lines grow with the corpus: always a shuffle, with the lists as the hashed side
    return (rows.join(gone.hint("shuffle_hash"), "uid", "left")
            .withColumns({"n_lines": F.when(field("row", text).isNull(), 0).otherwise(n), "gone": F.coalesce("gone", F.array().cast("array<int>")),
                          "kept_text": F.when(F.col("gone").isNull() | (F.size("gone") == 0), field("row", text)).otherwise(F.array_join(kept, "\n"))}))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies deleted from ``text`` and ``n_chars`` brought up to date, if there is such a column.

    Documents of which no line with a word is left go; documents that lost nothing stay, empty ones too.
    """
    done = dedup_lines(docs, min_words).where((F.size("gone") == 0) | (F.regexp_count("kept_text", F.lit(WORD)) > 0))
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("gone") == 0, field("row", "n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return restored(done, docs.columns, **changed)
