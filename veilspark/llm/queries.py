"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.chat import repair_roles
from veilspark.llm.codes import compress_vectors
from veilspark.llm.decontaminate import contained_items
from veilspark.llm.lines import drop_repeated_lines
from veilspark.llm.mixing import mix_sources
from veilspark.llm.neighbours import nearest
from veilspark.llm.setjoin import similar_documents
from veilspark.llm.sharding import shard_rows
from veilspark.llm.simhash import near_duplicates
from veilspark.llm.suffixes import drop_repeated_substrings
from veilspark.llm.tokens import count_tokens
from veilspark.llm.toxicity import score_toxicity
from veilspark.llm.turns import EMPTY_DIGEST, repair_conversations
from veilspark.operators.lookup import join_null_safe


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return shard_rows(docs, ["doc_id"], "text", shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").select("doc_id", "toxic")
    return score_toxicity(docs, labels, threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors, k=20)


OP3_SQL = """
WITH good AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


def op4_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return similar_documents(docs, percent=75, n=5).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
           lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM split),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b USING (shingle) WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(y) AS component_id
FROM sets JOIN reach ON reach.x = sets.doc_id GROUP BY sets.doc_id, s
"""


def _lines_removed(docs: DataFrame, runs: bool) -> DataFrame:
    done = drop_repeated_lines(docs, least=1, runs=runs)
    ends = F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"]))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        "n_units",
        "n_removed",
        removed.alias("bytes_removed"),
        F.array_join(ends, ",").alias("spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every line that is not blank is a unit, and so are several lines between blank ones."""
    return _lines_removed(_table(spark, folder, "documents").select("doc_id", "text"), runs=True)


def op5_every_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines only."""
    return _lines_removed(_table(spark, folder, "documents").select("doc_id", "text"), runs=False)


def _op5_sql(runs: bool) -> str:
    wrapped = """UNION ALL
  SELECT doc_id, min(k), max(k), string_agg(plain, ' ' ORDER BY k) FROM offsets WHERE plain <> ''
  GROUP BY doc_id, run HAVING count(*) > 1""" if runs else ""
    return rf"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line,
         len(string_split(text, chr(10))) AS last FROM documents),
placed AS (
  SELECT *, strlen(line) + CASE WHEN k < last THEN 1 ELSE 0 END AS size,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[	-
 ]+', ' ', 'g'), ' ') AS plain FROM lines),
offsets AS (
  SELECT *, sum(size) OVER w - size AS start, sum(CASE WHEN plain = '' THEN 1 ELSE 0 END) OVER w AS run
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
units AS (
  SELECT doc_id, k, k AS upto, plain FROM offsets WHERE plain <> ''
  {wrapped}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY doc_id, k) > 1 AS again FROM units),
counts AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE again) AS n_removed FROM ranked GROUP BY doc_id),
marked AS (
  SELECT o.*, EXISTS (SELECT 1 FROM ranked r WHERE again AND r.doc_id = o.doc_id AND o.k BETWEEN r.k AND r.upto) AS gone
  FROM offsets o),
islands AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM marked),
spans AS (
  SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM (
    SELECT doc_id, CAST(min(start) AS BIGINT) AS a, CAST(max(start + size) AS BIGINT) AS b FROM islands WHERE gone GROUP BY doc_id, island)
  GROUP BY doc_id),
texts AS (
  SELECT doc_id, CAST(sum(size) FILTER (WHERE gone) AS BIGINT) AS bytes_removed,
         string_agg(line || CASE WHEN k < last THEN chr(10) ELSE '' END, '' ORDER BY k) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(bytes_removed, 0) AS bytes_removed,
       coalesce(spans, '') AS spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts t LEFT JOIN counts c ON c.doc_id = t.doc_id LEFT JOIN spans s ON s.doc_id = t.doc_id
"""


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return repair_roles(_table(spark, folder, "conversations"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    done = drop_repeated_substrings(docs)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return count_tokens(docs, "text", model=model, limit=4096).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit"
    )


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    mixed = mix_sources(docs, power=0.5, seed="mix")
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "n_copies", "copy")


OP9_SQL = """
WITH RECURSIVE sized AS (SELECT *, coalesce(strlen(text), 0) + 1 AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS DOUBLE) AS bytes FROM sized GROUP BY source),
rates AS (
  SELECT source, sqrt(bytes) / sum(sqrt(bytes)) OVER () * sum(bytes) OVER () / bytes AS rate FROM sources),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < rate + 12 * sqrt(rate) + 30),
drawn AS (
  SELECT *, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM sized),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (SELECT count(*) FROM cdf WHERE cdf.source = d.source AND cdf.c <= d.u) AS n_copies
  FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, CAST(n_copies AS INTEGER) AS n_copies, CAST(copy AS INTEGER) AS copy
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted)
"""


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = contained_items(docs, _table(spark, folder, "benchmark"), percent=75)
    return found.select("doc_id", "item_id", "n_item", "n_shared")


OP10_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
split AS (
  SELECT kind, id, list_filter(string_split_regex(lower(text), '[\x09-\x0D\x20]+'), lambda w: w <> '') AS w FROM texts),
sets AS (
  SELECT kind, id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
           lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM split),
items AS (SELECT id AS item_id, len(s) AS n_item, unnest(s) AS shingle FROM sets WHERE kind = 'i'),
docs AS (SELECT id AS doc_id, unnest(s) AS shingle FROM sets WHERE kind = 'd')
SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_shared
FROM docs JOIN items USING (shingle) GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n_item) * 75
"""


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    done = compress_vectors(_table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
    return done.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates(docs, n=3, radius=3).select("doc_id", "fingerprint", "component_id")


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without their sentence ends, repeated or made user turns, by a checksum of
    conversation and turn. Nulls are one blank, in the checksum, too."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    kinds = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return kinds.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    damaged = damaged_conversations(rows)
    done = repair_conversations(damaged)
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = done.ordered.groupBy("conv").agg(F.coalesce(missing, F.lit(0)).alias("gaps"))
    digests = done.digests().withColumnRenamed("sha256", "repaired_sha256")
    found = join_null_safe(join_null_safe(done.conversations, gaps, ["conv"]), digests, ["conv"])
    ids = rows.select(F.col("conv_id").alias("conv")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return join_null_safe(ids, found, ["conv"], "left").select(
        F.col("conv").alias("conv_id"),
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(EMPTY_DIGEST)).alias("repaired_sha256"),
    )


def _op11_sql() -> str:
    """Four rounds written out: cross distances of all parts and entries, means, and the last assignment."""
    far = "list_inner_product(v, v) - 2 * list_inner_product(v, w) + list_inner_product(w, w)"
    steps = []
    for k in range(5):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, p, any_value(v) AS v, min({{'far': {far}, 'e': e}}) AS best FROM parts JOIN c{k} USING (p) GROUP BY r, p)""")
        if k < 4:
            steps.append(f"""m{k} AS (
  SELECT p, e, list(mean ORDER BY i) AS w FROM (
    SELECT p, e, i, floor(sum(x) / count(*)) AS mean FROM (
      SELECT p, best.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.w, c.w) AS w FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)""")
    return """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS whole, len(embedding) // 4 AS n
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, whole[p * n + 1:(p + 1) * n] AS v FROM kept, (SELECT unnest(range(4)) AS p)),
c0 AS (SELECT p, r - 1 AS e, v AS w FROM parts WHERE r <= 256),
""" + ",\n".join(steps) + """,
coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a4 GROUP BY r),
books AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS digest
  FROM (SELECT p, e, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM c4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM kept JOIN coded USING (r), books
"""


def _op13_sql() -> str:
    """Costs to go row by row from the end, then the least letters from the front."""
    # Costs to go behind the row: n0 nothing yet, n1 after system, n2 after user, n3 after assistant.
    stays = "CASE fault WHEN 't' THEN 5 ELSE 0 END"
    own = {
        q: f"least(2 + n{q}, CASE WHEN fault IN ('b', 'd') THEN 1e9 ELSE {stays} + least(1 + n{said}, "
        f"CASE initial WHEN '{letter}' THEN n{said} {'WHEN ' + chr(39) + 's' + chr(39) + ' THEN n1' if q == 0 else ''} ELSE 1e9 END) END)"
        for q, said, letter in ((0, 2, "u"), (1, 2, "u"), (2, 3, "a"), (3, 2, "u"))
    }
    said = "CASE WHEN q = 2 THEN 3 ELSE 2 END"
    return f"""
WITH RECURSIVE crc_bits AS (
  SELECT i AS start, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT start, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY start) AS crc FROM crc_bits WHERE k = 8),
plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (
  SELECT plain.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM plain, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
ordered AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS stripped
  FROM damaged d JOIN convs v ON d.conv_id IS NOT DISTINCT FROM v.conv_id),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth FROM ordered),
faults AS (
  SELECT c, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair,
         CASE WHEN stripped = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM seen),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY c),
back AS (
  SELECT c, n + 1 AS i, 0.0::DOUBLE AS n0, 10.0::DOUBLE AS n1, 5.0::DOUBLE AS n2, 0.0::DOUBLE AS n3 FROM counts
  UNION ALL
  SELECT c, i, least(e0, 5 + e2, 10 + e3), least(e1, 5 + e2, 10 + e3), least(e2, 5 + e3), least(e3, 5 + e2) FROM (
    SELECT back.c, f.i, {own[0]} AS e0, {own[1]} AS e1, {own[2]} AS e2, {own[3]} AS e3
    FROM back JOIN faults f ON f.c = back.c AND f.i = back.i - 1)),
moves AS (
  SELECT f.c, f.i, q, here.here, [here.n0, here.n1, here.n2, here.n3][{said} + 1] AS inserted, [b.n0, b.n1, b.n2, b.n3] AS behind,
         {said} AS said, initial, fault, {stays} AS stays, role, text
  FROM faults f JOIN back b ON b.c = f.c AND b.i = f.i + 1,
       LATERAL (SELECT h.n0, h.n1, h.n2, h.n3, q, [h.n0, h.n1, h.n2, h.n3][q + 1] AS here
                FROM back h, (SELECT unnest(range(4)) AS q) WHERE h.c = f.c AND h.i = f.i) here),
choices AS (
  SELECT c, i, q, said, role, text, initial,
         CASE WHEN 2 + behind[q + 1] = here THEN 'D' WHEN 5 + inserted = here THEN 'I'
              WHEN initial = 's' AND q = 0 AND stays + behind[2] = here THEN 'K'
              WHEN initial = CASE WHEN said = 3 THEN 'a' ELSE 'u' END AND stays + behind[said + 1] = here THEN 'K' ELSE 'R' END AS edit
  FROM moves
  UNION ALL SELECT c, n + 1, 1, 2, '', '', '', 'I' FROM counts UNION ALL SELECT c, n + 1, 2, 3, '', '', '', 'I' FROM counts),
played AS (
  SELECT c, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, '' AS audit, CAST([] AS VARCHAR[]) AS repaired FROM counts
  UNION ALL
  SELECT p.c, CASE WHEN edit = 'I' THEN p.i ELSE p.i + 1 END,
         CASE WHEN edit = 'D' THEN p.q WHEN edit = 'K' AND initial = 's' THEN 1 ELSE said END, audit || edit,
         CASE edit WHEN 'D' THEN repaired WHEN 'K' THEN list_append(repaired, role || ':' || text)
              ELSE list_append(repaired, CASE WHEN said = 3 THEN 'assistant:' ELSE 'user:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
  FROM played p JOIN choices m ON m.c = p.c AND m.i = p.i AND m.q = p.q),
ended AS (SELECT p.c, audit, repaired FROM played p JOIN counts k ON k.c = p.c WHERE p.i = k.n + 1 AND p.q IN (0, 3))
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.n0, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(repaired, chr(10)), '')) AS repaired_sha256
FROM convs v LEFT JOIN counts k ON k.c = v.c LEFT JOIN back b ON b.c = v.c AND b.i = 1 LEFT JOIN ended e ON e.c = v.c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_nearest_neighbours, op4_ngram_jaccard, op5_line_dedup, op5_every_line_dedup, op6_suffix_dedup, op7_token_counts, op8_chat_formatting, op9_mixing, op10_decontamination, op11_vector_codes, op12_simhash, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op3_nearest_neighbours": OP3_SQL, "op4_ngram_jaccard": OP4_SQL, "op5_line_dedup": _op5_sql(True), "op5_every_line_dedup": _op5_sql(False), "op9_mixing": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_vector_codes": _op11_sql(), "op13_conversation_repair": _op13_sql()}
