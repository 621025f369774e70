"""Queries of the problems tagged llm, 2 to 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import addresses as A
from tidewell.llm import boilerplate as B
from tidewell.llm import languages as G
from tidewell.llm import leaks as L
from tidewell.llm import pii as P
from tidewell.llm import splitting as S
from tidewell.llm import tokens as K
from tidewell.llm import turns as T
from tidewell.session import materialise, table


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.speech_rows(table(spark, sf_dir, "transcript_segments"), "call_id", "seg_idx", voice="speaker_id", start="start_sec", end="end_sec")


def _dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    # turn_idx gives the order there, so the time marks in the texts are not used
    rows = T.speech_rows(table(spark, sf_dir, "dialogue_turns").withColumn("at", F.col("turn_idx").cast("double")), "case_id", "turn_idx", speaker="speaker", start="at")
    return rows


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of the turns; TESTDATA.md counts runs of one role, so pauses don't part them here."""
    heads = lambda rows, src: T.turns(rows).select(F.lit(src).alias("src"), "conv_id", "turn_no", "role", "first_idx")
    return heads(_calls(spark, sf_dir), "transcript_segments").unionByName(heads(_dialogues(spark, sf_dir), "dialogue_turns"))


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns with their clean wording; in calls a turn also ends at a pause of eight times the usual one."""
    calls = T.turns(_calls(spark, sf_dir), pause_factor=8.0).withColumn("src", F.lit("transcript_segments"))
    talks = T.turns(_dialogues(spark, sf_dir)).withColumn("src", F.lit("dialogue_turns"))
    return calls.unionByName(talks)


def p2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-blank line of raw_text and of quality_reject_reason with its verdict."""
    pages = table(spark, sf_dir, "parsed_documents").select("page_id", F.col("source_url").alias("url"), "raw_text").dropDuplicates(["page_id"])
    quotes = table(spark, sf_dir, "quality_rejected").filter(F.col("quality_reject_reason").contains("\n"))
    quotes = quotes.select("record_id", F.col("source_url").alias("quote_url"), F.col("quality_reject_reason").alias("quote")).dropDuplicates(["record_id"])
    both = pages.join(quotes, F.col("page_id") == F.col("record_id"), "full_outer")
    both = both.select(F.col("page_id").cast("string").alias("rec_key"), F.coalesce("url", "quote_url").alias("url"), "raw_text", F.col("record_id").cast("string").alias("quote_key"), "quote")
    counts = B.induce(table(spark, sf_dir, "parsed_documents").select(F.col("source_url").alias("url"), "raw_text"), keep=lambda df: materialise(df, "p2"))
    lines = B.strip_boilerplate(both, *B.wrappers(counts))
    return lines.withColumn("src", F.when(F.col("src") == "page", "parsed_documents").otherwise("quality_rejected"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_lines(spark, sf_dir).filter(~F.col("body")).select("src", "rec_key", "line_no")


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str]]:
    orders, cases = table(spark, sf_dir, "workorders"), table(spark, sf_dir, "intake_cases")
    records = orders.select(F.col("case_id").alias("rec_key"), F.col("elements.location").alias("location")).unionByName(
        cases.select(F.col("id").alias("rec_key"), F.array_join(F.col("expected.location"), "，").alias("location"))
    )
    return records, A.district_names(orders.select("region"), cases.select("official_label.region"))


def p3_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The membership behind the pairs: each record that names a place, with the place."""
    records, districts = _places(spark, sf_dir)
    return A.members(records, districts, keep=lambda df: materialise(df, "p3")).select("rec_key", "place", "district", "town")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, districts = _places(spark, sf_dir)
    return A.match_addresses(records, districts, keep=lambda df: materialise(df, "p3"))


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, src, block_no, item_type, text of every item."""
    pages = table(spark, sf_dir, "parsed_documents")
    none = F.array().cast("array<struct<src:string,block_no:int,item_type:string,text:string>>")
    raw = F.array(F.struct(F.lit("raw_text").alias("src"), F.lit(-1).alias("block_no"), F.lit("raw_text").alias("item_type"), F.col("raw_text").alias("text")))
    blocks = F.transform("blocks", lambda b, i: F.struct(F.lit("block").alias("src"), i.alias("block_no"), b["block_type"].alias("item_type"), b["text"].alias("text")))
    return pages.select("page_id", F.inline(F.concat(raw, F.coalesce(blocks, none))))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every item that is too long; repeated pages count once."""
    items = p5_items(spark, sf_dir)
    limits = table(spark, sf_dir, "chunk_limits").select("item_type", "max_chars", "overlap_chars").dropDuplicates(["item_type"])
    over = items.join(limits, "item_type").filter(F.length("text") > F.col("max_chars")).dropDuplicates(["page_id", "src", "block_no"])
    return S.split_oversized(over, ["src", "page_id", "block_no"], "text", "max_chars", "overlap_chars")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).filter("piece_no = 0").select("src", "page_id", "block_no")


def _pii_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rec_key, turn_no, text, locations of every text with personal data; repeats count once."""
    orders, cases, talks = (table(spark, sf_dir, t) for t in ("workorders", "intake_cases", "dialogue_turns"))
    one = orders.select(F.lit("workorders").alias("src"), F.col("case_id").alias("rec_key"), F.lit(0).alias("turn_no"), F.col("source.raw_text").alias("text"), F.array("elements.location").alias("locations"))
    two = cases.select(F.lit("intake_cases").alias("src"), F.col("id").alias("rec_key"), F.lit(0).alias("turn_no"), "text", F.col("expected.location").alias("locations"))
    three = talks.select(F.lit("dialogue_turns").alias("src"), F.col("case_id").alias("rec_key"), F.col("turn_idx").alias("turn_no"), "text", F.array().cast("array<string>").alias("locations"))
    return one.unionByName(two).unionByName(three).dropDuplicates(["src", "rec_key", "turn_no"])


def _redactor(spark: SparkSession, sf_dir: str, texts: DataFrame) -> P.Redactor:
    districts = A.district_names(table(spark, sf_dir, "workorders").select("region"), table(spark, sf_dir, "intake_cases").select("official_label.region"))
    sample, locations = P.sample_texts(texts, ["src", "rec_key", "turn_no"], "text", "locations")
    count = lambda made: P.count_contexts(texts, "text", made, keep=lambda df: materialise(df, "p6"))
    return P.train(sample, tuple(districts.values()), locations, count=count)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _pii_texts(spark, sf_dir)
    return P.find_pii(texts, ["src", "rec_key", "turn_no"], "text", _redactor(spark, sf_dir, texts)).drop("probability")


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced by typed placeholders."""
    texts = _pii_texts(spark, sf_dir)
    return P.find_pii(texts, ["src", "rec_key", "turn_no"], "text", _redactor(spark, sf_dir, texts), masked=True)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return L.find_leaks(docs, "doc_id", "text", items, "item_id", "passage", keep=lambda df: materialise(df, "p8")).select("doc_id", "item_id")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and of every stretch of a mixed one."""
    return G.label_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p9_languages(spark, sf_dir)
    wrong = F.col("declared").isNull() | (F.col("declared") != F.col("lang_code"))
    return found.filter((F.col("seg_no") > 0) | wrong).select("doc_id", "seg_no", "lang_code")


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_lines": p2_lines,
        "p3_found": p3_found,
        "p3_places": p3_places,
        "p4_found": p4_found,
        "p4_turns": p4_turns,
        "p5_found": p5_found,
        "p5_pieces": p5_pieces,
        "p6_found": p6_found,
        "p6_masked": p6_masked,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p9_found": p9_found,
        "p9_languages": p9_languages,
    }


def oracle_sql() -> dict:
    """Only what SQL can say; the rest is tested against brute force, round trips and held-out accuracy."""
    return {
        "p5_found": """
            with items as (
                select page_id, 'raw_text' as src, -1 as block_no, 'raw_text' as item_type, raw_text as text from parsed_documents
                union all
                select page_id, 'block' as src, cast(i - 1 as int) as block_no, blocks[i].block_type as item_type, blocks[i].text as text
                from (select page_id, blocks, unnest(range(1, len(blocks) + 1)) as i from parsed_documents)
            )
            select distinct src, page_id, block_no from items join chunk_limits using (item_type) where length(text) > max_chars
        """,
    }
