"""Remove sentences inside runs of sentences that stood somewhere before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import write_table
from .common import SPACE, SPACES, ascii_lower, carried, let, restored
from .line_dedup import without

# After a full stop, exclamation or question mark before white space, and after line breaks.
SENTENCE_END = r"(?<=[.!?])(?=[\x20\x09-\x0D])|(?<=\n)(?=[^\n])"


def _runs(sentences: Column, min_sentences: int, min_words: int, alone_words: int | None) -> Column:
    """(first, last, key, key2) of the shortest sufficient run from each sentence on, null where there is none.

    A run needs at most max(min_sentences, min_words) sentences, as every sentence has a word.
    Sentences of ``alone_words`` words are runs of their own besides.
    """
    units = F.filter(
        F.transform(
            sentences,
            lambda s, i: let(
                F.regexp_replace(F.btrim(ascii_lower(s), F.lit(SPACE)), SPACES, " "),
                lambda k: F.struct(
                    F.when(k == "", None).otherwise(F.xxhash64(k)).alias("h"),
                    (F.length(k) - F.length(F.replace(k, F.lit(" "), F.lit(""))) + 1).alias("w"),
                    i.alias("p"),
                ),
            ),
        ),
        lambda u: u["h"].isNotNull(),
    )

    lengths = range(min_sentences, max(min_sentences, min_words) + 1)

    def found(h: Column, w: Column, p: Column) -> Column:
        def run(i: Column, n: int, least: int = min_words) -> Column:
            words = sum((F.get(w, i + j) for j in range(1, n)), F.get(w, i))
            part = F.slice(h, i + 1, n)
            return F.when(
                words >= least,
                F.struct(
                    F.get(p, i).alias("first"),
                    F.get(p, i + (n - 1)).alias("last"),
                    F.xxhash64(part).alias("key"),
                    F.hash(part).alias("key2"),
                ),
            )

        runs = F.transform(h, lambda _, i: F.coalesce(*[run(i, n) for n in lengths]))
        if alone_words is not None:
            runs = F.concat(runs, F.transform(h, lambda _, i: run(i, 1, alone_words)))
        return F.filter(runs, lambda r: r.isNotNull())

    # Each field becomes an array of its own once; taken from the structs at every use it would be built anew.
    return let(units, lambda u: let(u["h"], lambda h: let(u["w"], lambda w: let(u["p"], lambda p: found(h, w, p)))))


def dedup_sentence_runs(
    docs: DataFrame, min_sentences: int = 2, min_words: int = 10, alone_words: int | None = None
) -> DataFrame:
    """Remove every sentence covered by a run of sentences that occurred earlier in the corpus.

    Sentences end after ``. ! ?`` before white space and after line breaks; they are compared
    with A-Z lower-cased and white space as one space; sentences without a word are skipped.
    From every sentence slides the shortest run of at least ``min_sentences`` sentences and
    ``min_words`` words; with ``alone_words``, a sentence of so many words is a run by itself too.
    Of equal runs the one with the smallest (doc_id, hash of the text,
    position) is the first and stays; all others lose their sentences. Returns the columns of
    ``docs`` with ``text`` shortened, ``n_sentences`` and ``n_removed``. What stays is unchanged,
    its own white space included.

    One aggregate over the 96-bit hashes of runs, with partial results, gives each repeated run
    its first place; the runs are cut a second time and meet that table in a join that AQE can
    split, so a passage in a third of all documents costs rows in proportion to its copies and
    never pairs of them.

    Null and empty texts have no sentence to remove (``n_sentences`` 0). Rows equal in doc_id
    and text are one document: none loses text to the other, and each is returned. Different
    texts under one id are different documents; a null id sorts first. Repeats inside one
    document lose all but the first place.
    """
    rows = carried(docs).withColumn("_sentences", F.split("_text", SENTENCE_END, -1))
    runs = rows.select("_id", "_hash", F.explode(_runs(F.col("_sentences"), min_sentences, min_words, alone_words)).alias("_r"))
    runs = runs.select("_id", "_hash", *[F.col(f"_r.{c}").alias(f"_{c}") for c in ("first", "last", "key", "key2")])
    place = F.struct("_id", "_hash", "_first")
    found = runs.groupBy("_key", "_key2").agg(F.count(F.lit(1)).alias("_times"), F.min(place).alias("_where"))
    # Written, so that both sides of the join are plain shuffles, which AQE can split at a hot run.
    firsts = write_table(found.where("_times > 1").drop("_times"), "repeated-runs")
    later = runs.join(firsts, ["_key", "_key2"]).where(~place.eqNullSafe(F.col("_where")))
    hits = later.select(
        F.col("_id").alias("_hit"), F.col("_hash").alias("_hit_hash"), F.explode(F.sequence("_first", "_last")).alias("_p")
    )
    hits = hits.groupBy("_hit", "_hit_hash").agg(F.sort_array(F.collect_set("_p")).alias("_drop"))
    met = rows.drop("_sentences").join(
        hits, F.col("_id").eqNullSafe(F.col("_hit")) & (F.col("_hash") == F.col("_hit_hash")), "left"
    )
    met = met.withColumn("_sentences", F.split("_text", SENTENCE_END, -1))
    text = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(
        F.array_join(without(F.col("_sentences"), F.col("_drop")), "")
    )
    return restored(
        met,
        docs,
        text=text,
        n_sentences=F.when(F.col("_text") == "", 0).otherwise(F.size("_sentences")).cast("long"),
        n_removed=F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long"),
    )
