"""The views that queries run on, as SQL over the given tables, in Spark's and DuckDB's words."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_NOTES = """SELECT user_id AS clip_id, event_id % 2 AS side,
  {micros}/3.6e9 AS onset_s, {micros}/3.6e9 + value/100 AS offset_s,
  21 + cast({k} AS int) % 88 AS pitch, event_type = 'error' AS is_drum FROM {{events}}"""
_MSGS = """SELECT user_id AS clip_id, ts, event_id, cast({k} AS int) % 4 AS note,
  CASE event_type WHEN 'signup' THEN 'on' ELSE 'off' END AS kind FROM {{events}} WHERE event_type IN ('signup','purchase')"""
_SPARK_K, _DUCK_K = "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"
_SPARK_US = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)"
_DUCK_US = "date_diff('microsecond', TIMESTAMP '2024-01-01', ts)"

#: name -> SQL; a pair is (Spark, DuckDB). {name} stands for a table or an earlier view.
VIEWS: dict[str, str | tuple[str, str]] = {
    "fx_sources": """SELECT doc_id, concat(lang,'/',source,'/Doc ',cast(doc_id AS string),'-v1.txt') AS rel_path,
  lang AS class_name, source AS folder, n_chars AS size_bytes, doc_id*1000+7 AS mtime_ns FROM {documents}""",
    "fx_manifest_prev": """SELECT rel_path, CASE WHEN doc_id % 11 = 0 THEN size_bytes+1 ELSE size_bytes END AS size_bytes, mtime_ns
  FROM {fx_sources} WHERE doc_id % 10 <> 3
  UNION ALL SELECT concat('xx/gone/Doc ',cast(doc_id AS string),'-v1.txt'), n_chars, doc_id FROM {documents} WHERE doc_id % 25 = 0""",
    "fx_sidecar": """SELECT l.doc_id AS pos, CASE WHEN l.doc_id % 2 = 0 THEN upper(s.rel_path)
    ELSE concat('./elsewhere/Doc ',cast(l.doc_id AS string),'-v1.txt') END AS file,
  CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label,
  CASE WHEN toxic = 1 THEN ' * ' ELSE concat('  rated   ',cast(quality AS string)) END AS text
  FROM {labels} l JOIN {fx_sources} s ON l.doc_id = s.doc_id""",
    "fx_samples": """SELECT user_id AS clip_id,
  cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS int) AS seq, value/500.0 AS x FROM {events}""",
    "fx_clips": """SELECT cast(floor(vec_id/5) AS bigint) AS clip_id, cast(vec_id % 5 AS int) AS frame,
  CASE WHEN floor(vec_id/5) % 2 = 0 THEN 'real' ELSE 'gen' END AS side, label, embedding FROM {embeddings}""",
    "fx_latent_dims": (
        "SELECT clip_id, frame, side, d, v FROM {fx_clips} LATERAL VIEW posexplode(embedding) p AS d, v",
        "SELECT clip_id, frame, side, generate_subscripts(embedding,1)-1 AS d, unnest(embedding) AS v FROM {fx_clips}",
    ),
    "fx_curves": """SELECT user_id AS clip_id, day(ts)-1 AS frame,
  coalesce(avg(CASE WHEN event_type IN ('click','view') THEN value END),0) AS target,
  coalesce(avg(CASE WHEN event_type NOT IN ('click','view') THEN value END),0) AS generated
  FROM {events} GROUP BY user_id, day(ts)-1""",
    "fx_notes": (_NOTES.format(micros=_SPARK_US, k=_SPARK_K), _NOTES.format(micros=_DUCK_US, k=_DUCK_K)),
    "fx_msgs": (_MSGS.format(k=_SPARK_K), _MSGS.format(k=_DUCK_K)),
    "fx_scores": """SELECT user_id AS sample_id, event_type AS metric_key, CASE WHEN day(ts) <= 5 THEN 'cond' ELSE 'null' END AS arm,
  CASE WHEN min(value) < 2 THEN cast('NaN' AS double) ELSE avg(value) END AS score
  FROM {events} WHERE day(ts) <= 5 OR day(ts) > 25
  GROUP BY user_id, event_type, CASE WHEN day(ts) <= 5 THEN 'cond' ELSE 'null' END""",
    "fx_bank": "SELECT label AS class_name, vec_id, concat('img_',cast(vec_id AS string),'.png') AS file_name, embedding FROM {embeddings}",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the views."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _needs(sql)})


def duck(body: str) -> str:
    """DuckDB SQL with the views that ``body`` names (fx_...) before it; ``body`` may begin with its own WITH list."""
    todo, found = re.findall(r"\bfx_\w+", body), []
    while todo:
        name = todo.pop(0)
        sql = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][1]
        if name in found:
            found.remove(name)
        found.insert(0, name)
        todo += [n for n in _needs(sql) if n in VIEWS]
    parts = []
    for name in found:
        sql = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][1]
        parts.append(f"{name} AS ({re.sub(r'{(\w+)}', r'\1', sql)})")
    body = body.strip()
    own = body[4:].lstrip() if body.upper().startswith("WITH") else None
    recursive = ""
    if own and own.upper().startswith("RECURSIVE"):
        own, recursive = own[9:].lstrip(), "RECURSIVE "
    return (f"WITH {recursive}" + ", ".join(parts) + (", " + own if own else " " + body)) if parts else body
