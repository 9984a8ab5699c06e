"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import chat, pii, quality
from tillcast.llm.bpe import encode
from tillcast.llm.common import table, whole
from tillcast.llm.decontaminate import find_contamination
from tillcast.llm.exact_dedup import exact_dedup
from tillcast.llm.langid import held_out, identify, train
from tillcast.llm.line_dedup import line_dedup
from tillcast.llm.secrets import secret_report
from tillcast.llm.sharding import shard_documents
from tillcast.llm.simhash import simhash_groups
from tillcast.llm.spelling import spelling_variants, word_counts
from tillcast.llm.whitening import whiten

SLOP = 2  # words by which a proximity match may be off


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.train(docs))

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def rank(span: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, pii.KINDS)), span["kind"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    every = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(
        rank(a) != rank(b), (rank(a) - rank(b)).cast("int")).otherwise(a["start"] - b["start"]))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(whole("text"), 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                               slop=SLOP)
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated", "n_near",
                        F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.sql("""
        SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(id AS BIGINT) AS turn,
               IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text
        FROM range(2)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    read = chat.read_back(chat.conversations(chat.linear(turns.unionByName(control))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id", 5, 0)))
    named = identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.fit(quality.sample(docs, labels.where(~held_out("doc_id", 4, 2)), "quality"))
    return quality.score(docs.select("doc_id", "text"), weights).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_secrets": op10_secrets,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_sharding": op13_sharding,
}

# crc32 in SQL: the table by its rule, and a fold over the UTF-8 bytes of ``{text}``.
CRC_TABLE = """
            SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i:
                CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS tab
            FROM (SELECT unnest(range(256)) AS b)"""
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
                string_split({text}, ''), lambda c: CASE
                    WHEN c = '' THEN CAST([] AS BIGINT[])
                    WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)]
                    WHEN ord(c) < 2048 THEN [192 | (ord(c) >> 6), 128 | (ord(c) & 63)]
                    WHEN ord(c) < 65536 THEN
                        [224 | (ord(c) >> 12), 128 | ((ord(c) >> 6) & 63), 128 | (ord(c) & 63)]
                    ELSE [240 | (ord(c) >> 18), 128 | ((ord(c) >> 12) & 63),
                          128 | ((ord(c) >> 6) & 63), 128 | (ord(c) & 63)] END))),
                lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"""
ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
# As many other single-byte characters, so that edits of bytes are edits of letters.
STAND_INS = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) not in "'{}")[:64]

ORACLE = {
    "op11_spelling": f"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        runs AS (
            SELECT CAST(doc_id AS VARCHAR) || ':' AS d, unnest(list_transform(regexp_extract_all(
                coalesce(text, ''), '[A-Za-zÀ-ÿ]+'), lambda r: translate(
                    r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS r
            FROM documents),
        kinds AS (SELECT d, r, count(*) AS n FROM runs GROUP BY d, r),
        coded AS (SELECT r, n, {CRC32.format(text="d || r")} AS h FROM kinds, crc),
        damaged AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2)
                   ELSE r END AS word, n FROM coded),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n,
                   translate(word, '{ACCENTED}', '{STAND_INS}') AS w
            FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n
            FROM words a JOIN words b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1
            WHERE levenshtein(a.w, b.w) = 1),
        best AS (
            SELECT word, count(*) AS n_near, max(other_n) AS best_n,
                   first(other ORDER BY other_n DESC, other) AS best
            FROM near GROUP BY word),
        formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN best_n >= 2 * n THEN best END AS form,
                   CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
            FROM words LEFT JOIN best USING (word)),
        chain AS (
            SELECT word, word AS root FROM formed
            UNION ALL
            SELECT chain.word, formed.form FROM chain JOIN formed ON chain.root = formed.word
            WHERE formed.form IS NOT NULL),
        ends AS (
            SELECT chain.word, root FROM chain JOIN formed ON root = formed.word WHERE form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)""",
    "op13_sharding": f"""
        WITH crc AS ({CRC_TABLE}),
        sized AS (
            SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
                   CAST({CRC32.format(text="coalesce(text, '')")} AS BIGINT) AS text_crc32
            FROM documents, crc),
        placed AS (
            SELECT *, sum(size) OVER (ORDER BY text_crc32, doc_id ROWS UNBOUNDED PRECEDING) - size AS below,
                   sum(size) OVER () AS total FROM sized),
        cut AS (
            SELECT *, CAST((2 * below + size) * 4 // total AS INT) AS shard FROM placed)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
               row_number() OVER (PARTITION BY shard ORDER BY text_crc32, doc_id) - 1 AS slot,
               CAST(NULL AS INT) AS grown_shard
        FROM cut""",
    "op2_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines),
        shared AS (
            SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10
            GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
        marked AS (
            SELECT doc_id, pos, line, first_id IS NOT NULL AND doc_id <> first_id AS gone
            FROM keyed LEFT JOIN shared USING (k))
        SELECT doc_id, count(*) AS n_lines,
               CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
                   AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op3_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bs AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
               FROM b WHERE len(w) > 0),
        bw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM bs),
        sizes AS (SELECT DISTINCT n FROM bw),
        ds AS (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s
               FROM d, sizes WHERE len(w) >= n),
        hit AS (
            SELECT doc_id, s, n, item
            FROM (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM ds)
            JOIN bw USING (n, k)),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                   FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
        iw AS (SELECT item, len(w) AS size, unnest(w) AS t, unnest(range(len(w))) AS p FROM b WHERE len(w) > 0),
        dw AS (SELECT doc_id, t, p FROM (
                   SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d)
               WHERE t IN (SELECT t FROM iw)),
        seen AS (SELECT t, count(*) AS c FROM dw GROUP BY t),
        spans AS (
            SELECT s.item, s.p AS s, list_sort(list({'c': coalesce(c, 0), 't': i.t, 'p': i.p})) AS ws
            FROM iw s JOIN iw i ON i.item = s.item AND i.p BETWEEN s.p AND s.p + 9
                 LEFT JOIN seen ON seen.t = i.t
            WHERE s.p <= greatest(s.size - 10, 0) GROUP BY s.item, s.p),
        pairs AS (
            SELECT DISTINCT item, ws[1].t AS t1, coalesce(ws[2].t, ws[1].t) AS t2,
                   coalesce(ws[2].p, ws[1].p) - ws[1].p AS apart
            FROM spans WHERE ws[1].c > 0),
        near AS (
            SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT x.doc_id, item FROM pairs JOIN dw x ON x.t = t1
                  JOIN dw y ON y.doc_id = x.doc_id AND y.t = t2 AND y.p - x.p - apart BETWEEN -2 AND 2)
            GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(named.items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
               CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
               sha256(coalesce(near.items, '')) AS near_sha256
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
             LEFT JOIN near USING (doc_id)""",
    "op4_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        f AS (
            SELECT *, length('<s>[INST][/INST]</s>') + length(role) + length(text)
                   + 4 * (length(role || text) - length(replace(role || text, '&', '')))
                   + 3 * (length(role || text) - length(replace(role || text, '<', '')))
                   + 5 * (length(role || text) - length(replace(role || text, '[', ''))) AS n
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
                   AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                               FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id""",
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
            FROM documents),
        g AS (
            SELECT doc_id, s, first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY s) AS group_size
            FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM g""",
}
