"""The queries of this package and their SQL: one ``opN_<name>`` for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import packing
from scanloom.llm.call_source import tools, with_calls
from scanloom.llm.chat_format import format_chats
from scanloom.llm.common import WORD, crc_mod, table
from scanloom.llm.decontaminate import leaks
from scanloom.llm.exact_dedup import exact_groups
from scanloom.llm.line_dedup import line_dedup
from scanloom.llm.near_dedup import near_groups
from scanloom.llm.packing import pack
from scanloom.llm.quality import fit_quality, score_quality
from scanloom.llm.sharding import shards
from scanloom.llm.substring_dedup import substring_dedup
from scanloom.llm.toxicity import fit_toxicity, score_toxicity

#: The given tables are far smaller than a corpus: a shard of theirs holds less than ``sharding.LIMIT``.
SHARD_BYTES = 1 << 17


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.col("threshold").alias("lang_threshold"), F.col("toxic").alias("lang_toxic"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), percent=85)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(with_calls(table(spark, sf_dir, "conversations")), tools(spark))
    return out.withColumns({"errors": F.array_join("errors", ";"), "call_id": F.coalesce("call_id", F.lit("")), "linked_turn": F.coalesce("linked_turn", F.lit(-1))})


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_template_decontamination, op3_line_dedup, op4_minhash_near_dedup, op5_chat_formatting, op6_length_buckets, op7_extendible_sharding, op8_quality, op9_substring_dedup, op10_exact_dedup)
    return {f.__name__: f for f in found}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIP = r"regexp_replace(regexp_replace({}, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": f"""
            WITH lines AS (
                SELECT doc_id, pos, l.parts[pos] AS line, {_LOWER.format(_STRIP.format('l.parts[pos]'))} AS k
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) l,
                     unnest(range(1, len(l.parts) + 1)) AS u(pos)),
            common AS (SELECT k, max(doc_id) AS keep_id FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
            marked AS (SELECT doc_id, pos, line, coalesce(doc_id <> keep_id, false) AS gone FROM lines LEFT JOIN common USING (k))
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
            FROM marked GROUP BY doc_id""",
        "op4_minhash_near_dedup": f"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
                  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
            e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
            r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
            SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, r.doc_id = min(root) AS kept
            FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
        "op9_substring_dedup": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
            m AS (SELECT k, min(doc_id) AS first_id FROM win GROUP BY k),
            gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM win JOIN m USING (k), range(13) t(j) WHERE first_id < doc_id),
            words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
            kept AS (SELECT doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY words.pos) FILTER (g.pos IS NULL) AS text
                     FROM words LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
            SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
            FROM w LEFT JOIN kept USING (doc_id)""",
        # The rules of call_source, then linking, levels, validation and JSON, each by other means.
        "op5_chat_formatting": """
            WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
            own AS (SELECT DISTINCT conv_id FROM b WHERE role = 'system'),
            c AS (SELECT conv_id, turn, n, 0 AS call_index, 't' || turn AS id, 'measure' AS name,
                         CASE WHEN turn >= 3 THEN ['t' || (turn - 2)] ELSE []::VARCHAR[] END AS deps,
                         '{' || CASE WHEN n % 5 <> 0 THEN '"n_chars":' || n || ',' ELSE '' END || CASE WHEN n % 7 = 0 THEN '"note":"x",' ELSE '' END
                             || '"style":"' || ['plain', 'list', 'code'][n % 3 + 1] || '","turn":' || turn || '}' AS args,
                         list_filter([CASE WHEN n % 3 = 2 AND conv_id NOT IN (FROM own) THEN 'invalid:style' END, CASE WHEN n % 5 = 0 THEN 'missing:n_chars' END,
                                      CASE WHEN n % 7 = 0 THEN 'unexpected:note' END], lambda x: x IS NOT NULL) AS errors
                  FROM b WHERE role = 'assistant'
                  UNION ALL
                  SELECT conv_id, turn, n, 1, 'u' || (turn % 4), CASE WHEN n % 2 = 0 THEN 'find' ELSE 'guess' END,
                         list_sort(CASE WHEN turn >= 3 THEN ['t' || (turn - 2), 't' || turn] ELSE ['t' || turn] END),
                         CASE WHEN n % 11 = 0 THEN NULL WHEN n % 3 = 0 THEN '{"q":"' || n || '"}' ELSE '{"q":' || n || '}' END,
                         CASE WHEN n % 11 = 0 THEN ['arguments:not_an_object'] WHEN n % 2 <> 0 THEN ['tool:not_declared'] WHEN n % 3 <> 0 THEN ['invalid:q'] ELSE []::VARCHAR[] END
                  FROM b WHERE role = 'assistant'),
            r AS (SELECT conv_id, turn, 't' || (turn - 1) AS id, '{"n":' || n || ',"ok":true}' AS content FROM b WHERE role = 'user' AND turn >= 1
                  UNION ALL SELECT conv_id, turn, 'u' || ((turn - 1) % 4), '[' || n || ',' || turn || ']' FROM b WHERE role = 'user' AND turn >= 1 AND n % 4 = 0),
            f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, call_index) = 1 AS first FROM c),
            heads AS (SELECT conv_id, id, turn, call_index FROM f WHERE first),
            e AS (SELECT conv_id, id, turn, unnest(deps) AS need FROM f WHERE first),
            dead AS (SELECT e.conv_id, e.id FROM e LEFT JOIN heads h ON h.conv_id = e.conv_id AND h.id = e.need WHERE h.turn IS NULL OR h.turn > e.turn
                     UNION SELECT e.conv_id, e.id FROM dead JOIN e ON e.conv_id = dead.conv_id AND e.need = dead.id),
            paths AS (SELECT conv_id, id, 0 AS level FROM f WHERE first AND len(deps) = 0
                      UNION ALL SELECT e.conv_id, e.id, level + 1 FROM paths JOIN e ON e.conv_id = paths.conv_id AND e.need = paths.id),
            lv AS (SELECT p.conv_id, p.id, max(level) AS level FROM paths p LEFT JOIN (SELECT DISTINCT * FROM dead) d ON d.conv_id = p.conv_id AND d.id = p.id WHERE d.id IS NULL GROUP BY ALL),
            a AS (SELECT conv_id, id, min(turn) AS answer FROM r GROUP BY ALL)
            SELECT conv_id, turn, role, 'message' AS kind, turn AS anchor_turn, 0 AS level, -1 AS call_index, 0 AS kind_rank, '' AS call_id, -1::BIGINT AS linked_turn,
                   'ok' AS status, '' AS errors, json_object('content', text, 'role', role, 'type', 'message')::VARCHAR AS json FROM b
            UNION ALL
            SELECT conv_id, turn, role, 'message', turn, 0, -1, 0, '', -1, 'ok', '', CASE role
                   WHEN 'assistant' THEN '{"content":"","role":"assistant","type":"message"}'
                   ELSE json_object('content', '{"content": "", "tools": [{"name": "measure", "parameters": {"type": "object", "properties": {"n_chars": {"type": "integer"}, "turn": {"type": "integer"}, "style": {"type": "string", "enum": ["plain", "list", "code"]}}, "required": ["n_chars"], "additionalProperties": false}}]}', 'role', role, 'type', 'message')::VARCHAR END
            FROM b WHERE role IN ('assistant', 'system')
            UNION ALL
            SELECT f.conv_id, f.turn, 'assistant', 'call', f.turn, coalesce(lv.level, 0), f.call_index, 1, f.id, CASE WHEN first THEN coalesce(answer, -1) ELSE -1 END,
                   CASE WHEN NOT first THEN 'duplicate' WHEN lv.level IS NULL THEN 'unordered' WHEN answer IS NULL THEN 'unanswered' ELSE 'ok' END, array_to_string(errors, ';'),
                   '{' || coalesce('"arguments":' || args || ',', '') || '"depends_on":' || to_json(deps) || ',"id":"' || f.id || '","name":"' || name || '","type":"call"}'
            FROM f LEFT JOIN lv USING (conv_id, id) LEFT JOIN a USING (conv_id, id)
            UNION ALL
            SELECT r.conv_id, r.turn, 'tool', 'result', coalesce(h.turn, r.turn), coalesce(lv.level, 0), coalesce(h.call_index, -1), 2, r.id, coalesce(h.turn, -1),
                   CASE WHEN h.turn IS NULL THEN 'orphan' WHEN r.turn <> answer THEN 'duplicate' ELSE 'ok' END, '',
                   '{"content":' || content || ',"id":"' || r.id || '","type":"result"}'
            FROM r LEFT JOIN heads h USING (conv_id, id) LEFT JOIN lv USING (conv_id, id) LEFT JOIN a USING (conv_id, id)""",
        # One step of the recursion allows one bucket more; of equal totals the earliest begin wins, as in the module.
        "op6_length_buckets": rf"""
            WITH RECURSIVE d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words,
                                        ('0x' || substr(md5(concat_ws('/', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS ord
                                 FROM documents),
            w AS (SELECT doc_id, CASE WHEN words > 0 THEN words + 1 ELSE 0 END::BIGINT AS n_tokens, ord FROM d),
            h AS (SELECT n_tokens AS x, count(*) AS c, row_number() OVER (ORDER BY n_tokens) AS j FROM w GROUP BY n_tokens),
            g AS (SELECT j, x, sum(c) OVER (ORDER BY j)::BIGINT AS r FROM h UNION ALL SELECT 0, 0, 0),
            p AS (SELECT 0 AS k, 0::BIGINT AS j, 0::BIGINT AS r, 0::BIGINT AS cost, []::BIGINT[] AS ends
                  UNION ALL
                  SELECT k, j, r, best.cost, best.ends
                  FROM (SELECT p.k + 1 AS k, g.j, g.r, min({{'cost': p.cost + g.x * (g.r - p.r), 'i': p.j, 'ends': list_append(p.ends, g.x)}}) AS best
                        FROM p JOIN g ON g.j > p.j WHERE p.k < {packing.BUCKETS} GROUP BY p.k, g.j, g.r)),
            e AS (SELECT ends FROM p WHERE j = (SELECT max(j) FROM g) ORDER BY cost, k LIMIT 1),
            b AS (SELECT w.*, list_min(list_filter(ends, lambda z: z >= n_tokens)) AS bucket FROM w, e),
            n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ord, doc_id, n_tokens) - 1 AS nth, greatest(1, {packing.BUDGET} // greatest(bucket, 1)) AS each FROM b)
            SELECT doc_id, n_tokens, bucket, nth // each AS batch, nth % each AS slot FROM n""",
        "op7_extendible_sharding": f"""
            WITH r AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                              ('0x' || substr(md5(concat_ws('/', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS bits
                       FROM documents),
            t AS (SELECT r.*, depth, bits >> (60 - depth) AS p FROM r, range(0, 61) AS d(depth)),
            s AS (SELECT depth, p, sum(n_bytes)::BIGINT AS shard_bytes, min(bits) = max(bits) AS one FROM t GROUP BY depth, p),
            f AS (SELECT t.*, shard_bytes, row_number() OVER (PARTITION BY doc_id, bits ORDER BY t.depth) AS n
                  FROM t JOIN s USING (depth, p) WHERE shard_bytes <= {SHARD_BYTES} OR one OR depth = 60)
            SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(format('{{:b}}', p), depth::INTEGER, '0') END AS shard,
                   shard_bytes, shard_bytes <= {SHARD_BYTES} AS fits FROM f WHERE n = 1""",
        "op10_exact_dedup": r"""
            WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
            w AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM n)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM w""",
    }
