"""Drop lines that recur across documents, by templates of their fixed words.

A tree of fixed depth sorts lines: by the number of their words, then by the
leading words (words with digits count as variable there). In a leaf that lines
of enough documents reach, a word is fixed at its place if enough documents have
it there, and variable otherwise; a line's template is its words with variable
ones generalised. Lines whose template, or whose exact wording, stands in enough
documents are dropped. Two documents are enough for a line of 50 words or more;
its words are fixed at every count from two to that of short lines, and each of
these templates counts.

Everything is a count by key with partial sums, so a leaf or line that a third
of all documents share costs no task more than others. Lines and templates are counted
by 128-bit hashes; texts move once, each line's once per task. Words of lines in frequented
leaves are counted as 64-bit hashes of leaf, place and word, and a line looks the counts
of its words up by such hashes and its number. That two of them collide is as good as impossible for one pair of words (2^-64).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litframe.llm.frames import empty_text, release, stage

#: Leading words that are levels of the tree.
DEPTH = 2
#: Documents that a line or template must stand in to recur.
LEAST_DOCS = 10
#: Words from which a line is a passage, and documents that prove that one recurs.
LONG_WORDS = 50
LONG_DOCS = 2
#: Share of fixed words that a template needs.
FIXED_SHARE = 0.7
#: Words that a template with variable ones needs.
LEAST_WORDS = 4

VARIABLE = "<*>"


def masked(words: Column) -> Column:
    """Words with digits are variable from the start."""
    return F.transform(words, lambda w: F.when(w.rlike(r"[0-9]"), VARIABLE).otherwise(w))


def _leaf(words: Column, depth: int) -> Column:
    return F.xxhash64(F.size(words), F.array_join(masked(F.slice(words, 1, depth)), " "))


def _place(at: Column, word: Column) -> Column:
    """A word at a place of a leaf."""
    return F.xxhash64("leaf", at, word)


def _counted(words: Column, counts: Column) -> Column:
    """Words with the counts of their places, 0 where there is none."""
    none = F.transform(words, lambda w, at: F.struct(at.alias("at"), F.lit(0).cast("long").alias("n")))
    found = F.coalesce(counts, F.array().cast("array<struct<at:int,n:bigint>>"))
    # of two entries of a place the second one has the count
    entries = F.sort_array(F.concat(none, found))
    last = F.filter(
        F.zip_with(entries, F.slice(entries, 2, F.size(entries)), lambda e, after: F.when(after.isNull() | (after["at"] != e["at"]), e)),
        lambda e: e.isNotNull(),
    )
    return F.zip_with(words, last, lambda w, e: F.struct(w.alias("word"), e["n"].alias("n")))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, depth: int = DEPTH) -> DataFrame:
    """``line`` (a hash), ``docs`` and ``template`` of distinct lines that recur."""
    spark = docs.sparkSession
    # numbered first: an explode beside it would number the lines
    rows = docs.select(F.monotonically_increasing_id().alias("row"), empty_text(text_col).alias("text"))
    lines = F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))).alias("text")
    # lines are counted by their hash; only those that may recur are fetched with their text
    marks = rows.select("row", lines).filter("text <> ''").withColumn("words", F.split("text", r"\s+")).select(
        "row", _leaf(F.col("words"), depth).alias("leaf"), (F.size("words") >= LONG_WORDS).alias("long"), _key(F.col("text")).alias("line")
    )
    least = F.when(F.col("long"), min(LONG_DOCS, least_docs)).otherwise(least_docs)
    own = stage(
        marks.groupBy("leaf", "long", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("row").alias("first"), F.max("row").alias("last")),
        "lines",
    )
    release(spark)
    frequented = own.groupBy("leaf", "long").agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("lines")).filter(F.col("n") >= least)
    # a leaf of one line has no template but that line
    wanted = stage(
        own.join(frequented.select("leaf", "long", (F.col("lines") > 1).alias("mixed")), ["leaf", "long"])
        .filter(F.col("mixed") | (F.col("docs") >= least)), "wanted"
    )
    texts = rows.select(lines).filter("text <> ''").groupBy(_key(F.col("text")).alias("line")).agg(F.first("text").alias("text"))
    words = masked(F.split("text", r"\s+"))
    numbered = {
        "no": F.monotonically_increasing_id(), "n_words": F.size(words),
        "n_places": F.size(F.filter(words, lambda w: w != VARIABLE)),
    }
    known = stage(wanted.join(texts, "line").withColumns(numbered), "known")
    release(spark)
    alone = known.filter("not mixed").select("line", "docs", F.array_join(words, " ").alias("template"))
    together = known.filter("mixed")

    def general(n_fixed):
        return (n_fixed >= FIXED_SHARE * F.col("n_words")) & (F.col("n_words") >= LEAST_WORDS)

    # words at their places are counted as numbers, without the lines that hold them;
    # a variable one is at none
    spelt = F.transform(words, lambda w, at: F.struct(at.alias("at"), F.when(w != VARIABLE, _place(at, w)).alias("place")))
    placed = F.filter(spelt, lambda x: x["place"].isNotNull())
    fixed = stage(
        together.select("long", "docs", F.explode(placed).alias("x"))
        .groupBy("x.place", "long").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least).select("place", "n"), "fixed"
    )
    # a line looks its fixed words up by its number; its text stays where it is
    hopeful = together.filter(general(F.col("n_places")) | (F.col("docs") >= least))
    counts = stage(
        hopeful.select("no", F.explode(placed).alias("x")).select("no", "x.at", "x.place")
        .join(fixed, "place").groupBy("no").agg(F.collect_list(F.struct("at", "n")).alias("counts")), "counts"
    )
    release(spark)
    marked = hopeful.join(counts, "no", "left").filter(general(F.coalesce(F.size("counts"), F.lit(0))) | (F.col("docs") >= least))

    def shown(level):
        return F.array_join(F.transform("words", lambda w: F.when(w["n"] >= level, w["word"]).otherwise(VARIABLE)), " ")

    # the more documents a fixed word needs, the more general is the template
    levels = F.when(F.col("long"), F.sequence(least, F.lit(least_docs))).otherwise(F.array(F.lit(least_docs)))
    templates = F.transform(
        F.filter(levels, lambda level: general(F.size(F.filter("words", lambda w: w["n"] >= level)))), shown
    )
    made = (
        marked.select(
            "leaf", "long", "line", "docs", "first", "last", "n_words",
            # out of a generator, so that the words of a line are counted once, not for each template
            F.explode(F.array(_counted(words, F.col("counts")))).alias("words"),
        )
        .withColumn("templates", F.array_distinct(templates))
        .withColumn("exact", F.when(F.col("docs") >= least, shown(least)))
        .filter("size(templates) > 0 or exact is not null").drop("words", "n_words")
    )
    made = stage(made, "templates")
    fits = made.select("leaf", "long", "line", "docs", "first", "last", F.explode("templates").alias("template")).withColumn(
        "kind", _key(F.col("template"))
    )
    # the lines of one template may be of one document; two documents have two numbers
    several = F.when(F.col("long"), F.col("first") < F.col("last")).otherwise(F.col("d") >= least_docs)
    often = (
        fits.groupBy("leaf", "long", "kind")
        .agg(F.sum("docs").alias("d"), F.min("first").alias("first"), F.max("last").alias("last"))
        .filter(several).select("leaf", "kind")
    )
    by_template = fits.join(often, ["leaf", "kind"], "left_semi").select("line", "docs", "template")
    by_itself = made.filter("exact is not null").select("line", "docs", F.col("exact").alias("template"))
    return alone.unionByName(by_template).unionByName(by_itself).groupBy("line", "docs").agg(F.min("template").alias("template"))


def drop_recurring(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_docs: int = LEAST_DOCS,
    depth: int = DEPTH,
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row: recurring lines are gone.

    Lines end at line feeds and are compared without white space at their ends;
    empty lines stay. A line counts once per row, so a document that repeats it
    does not make it recur; nor do its own lines of one template, from 50 words on,
    where two documents prove a line or template. Null texts are empty texts (one empty line); repeated
    rows count as documents of their own. An empty table gives no rows.
    """
    gone = stage(recurring(docs, id_col, text_col, least_docs, depth).select("line").distinct(), "recurring")
    release(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_text(text_col).alias("text")).withColumn(
        "row", F.xxhash64("doc_id", F.md5("text"))
    )
    parts = F.transform(F.split("text", "\n"), lambda x: _key(F.trim(x)))
    hit = (
        rows.select("row", F.explode(F.array_distinct(parts)).alias("line"))
        .join(gone, "line", "left_semi")
        .groupBy("row").agg(F.collect_set("line").alias("gone"))
    )
    found = rows.join(hit, "row", "left").withColumn("lines", F.split("text", "\n"))
    left = F.filter(
        "lines", lambda x: ~F.coalesce(F.array_contains("gone", _key(F.trim(x))), F.lit(False))
    )
    return found.withColumn("left", left).select(
        "doc_id", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("left")).alias("n_dropped"),
        F.array_join("left", "\n").alias("text"),
    )
