"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litframe.llm import chat, collocations, decontaminate, exact_dedup, hard_negatives, importance, line_templates
from litframe.llm import mixing, ngram_join, quality_rules, resharding, token_codes, toxicity
from litframe.llm.frames import empty_text, table
from litframe.sources.scratch import scratch_dir

OLD_SHARDS, NEW_SHARDS = 16, 24


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op2_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by hash of the id to 24 of equal bytes; read from the files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS))
    done = resharding.reshard(docs, old, NEW_SHARDS)
    files = resharding.rewrite(done, scratch_dir(spark, "shards"))
    return files.select(
        "doc_id", resharding.document_size(F.col("text")).alias("size"),
        F.crc32(empty_text("text").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a fifth of the ids (by crc32) are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, lexicon).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight", "words",
    )


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, then read back from the files."""
    path = scratch_dir(spark, "codes")
    token_codes.write_codes(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_codes.documents(token_codes.read_codes(spark, path))


def op7_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, F.array("source"))
    # one row per source
    goals = spark.createDataFrame(
        [(s, n, t) for s, (n, t) in mixed.goals.items()], "_source string, source_size long, target double"
    )
    return mixed.rows.join(goals, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", F.col("mix_size").alias("size"), "source_size", "target",
        (F.col("mix_size") * F.col("mix_times")).alias("taken"), "source",
    )


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_parts(table(spark, sf_dir, "conversations"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "labels"))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.collocations(docs, least=100, top=2000)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a seventh of the rows are moved on by one; a hundredth are anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, label_col=label)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}
    return named | {"pipeline": corpus_pipeline.run}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express on the small tables."""
    alnum = f"regexp_extract_all({LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return {
        "op3_ngram_join": f"""
            with recursive words as (
              select doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
            sets as (
              select distinct doc_id, array_to_string(w[i : i + 2], ' ') as gram
              from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) as i from words)),
            sizes as (select doc_id, count(*) as n from sets group by doc_id),
            shared as (
              select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b
              on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
            links as (
              select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
              where 100 * c >= 90 * (x.n + y.n - c)),
            reached as (
              select doc_id as a, doc_id as b from documents
              union select r.a, l.b from reached r join links l on r.b = l.a),
            least as (select a, min(b) as component_id from reached group by a)
            select doc_id, coalesce(n, 0) as n_shingles, component_id
            from documents left join sizes using (doc_id) join least on a = doc_id""",
        "op8_chat_snapshots": """
            with turns as (
              select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place
              from conversations),
            logs as (select conv_id, list({'role': role, 'text': text} order by place) as log from turns group by conv_id),
            kept as (
              select min(conv_id) as conv_id, log from logs a
              where not exists (from logs b where len(b.log) > len(a.log) and b.log[1 : len(a.log)] = a.log)
              group by log),
            pieces as (
              select conv_id, len(log) as turns, place,
                '<|im_start|>' || regexp_replace(role, '[<|>\\s]+', '_', 'g') || chr(10)
                || regexp_replace(text, '<\\|(im_start|im_end)\\|>', '< |\\1| >', 'g') || '<|im_end|>' || chr(10) as piece
              from kept join turns using (conv_id))
            select conv_id, turns, place // 64 as part, min(place) as first_turn,
              string_agg(piece, '' order by place) as text
            from pieces group by conv_id, turns, place // 64""",
        "op10_fm_decontamination": f"""
            with docs as (select doc_id, {alnum} as w from documents),
            items as (select cast(item_id as varchar) as item, {alnum} as w from benchmark),
            windows as (
              select distinct item, k, array_to_string(w[i : i + k - 1], ' ') as phrase
              from (select item, w, least(len(w), 13) as k, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i
                from items where len(w) > 0)),
            places as (
              select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as phrase
              from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i
                from docs, (select distinct k from windows))),
            found as (select doc_id, i, k, item from places join windows using (k, phrase)),
            hit as (
              select doc_id, count(distinct pos) as n_hit
              from (select doc_id, unnest(range(i, i + k)) as pos from found) group by doc_id),
            named as (
              select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
              from (select distinct doc_id, item from found) group by doc_id)
            select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
              sha256(coalesce(items, '')) as items_sha256,
              coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
            from docs left join hit using (doc_id) left join named using (doc_id)""",
        "op11_collocations": f"""
            with words as (
              select coalesce(lang, 'und') as lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w
              from (select lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
            f as (
              select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as f
              from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 6) as t(k))
              group by all having count(*) >= 100),
            n as (select lang, sum(len(w)) as n from words group by lang),
            cuts as (
              select lang, phrase, len, f as a, c, array_to_string(string_split(phrase, ' ')[: c], ' ') as head,
                array_to_string(string_split(phrase, ' ')[c + 1 :], ' ') as tail
              from (select lang, phrase, k as len, f, unnest(range(1, k)) as c from f where k > 1)),
            scored as (
              select x.lang, x.phrase, x.len, x.a, x.c, y.f as l, z.f as r, n.n,
                (1000::hugeint * x.a * n.n) // (y.f::hugeint * z.f) as score
              from cuts x join f y on y.lang = x.lang and y.phrase = x.head
              join f z on z.lang = x.lang and z.phrase = x.tail join n on n.lang = x.lang),
            best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
            inside as (
              select lang, k, f, unnest(range(1, k - m + 2)) as i, m, string_split(phrase, ' ') as w
              from f, range(2, 5) as t(m) where m < k),
            covered as (
              select distinct b.lang, b.phrase from best b join inside i
              on b.lang = i.lang and b.phrase = array_to_string(i.w[i.i : i.i + i.m - 1], ' ') and 100 * i.f >= 100 * b.a)
            select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank,
              phrase, a, l, r, n::bigint as n, score::bigint as score
            from best anti join covered using (lang, phrase) qualify rank <= 2000""",
        "op12_hard_negatives": """
            with rows as (
              select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                [floor(256 * x::double) for x in embedding] as q
              from embeddings
              where label is not null and embedding is not null
                and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
            pairs as (
              select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same,
                list_inner_product(a.q, b.q)::bigint as score
              from rows a join rows b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
            near as (
              select anchor_id, other as positive_id, score as positive_score from pairs where same
              qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
            select anchor_id, positive_id,
              row_number() over (partition by anchor_id, positive_id order by score desc, other)::int as rank,
              other as negative_id, positive_score, score as negative_score
            from near join pairs using (anchor_id)
            where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
            qualify rank <= 10""",
        "op1_exact_dedup": """
            select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
              doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
            from documents window w as (partition by coalesce(text, ''))""",
    }
