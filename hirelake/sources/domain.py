"""Domain tables derived from the star-schema test tables: one SQL text for Spark and for the SQL checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hirelake.session import spread

#: The moment that "now" means in every job; jobs take it as a parameter.
AS_OF = "2024-03-01 00:00:00"

_ROLES = "Python Developer,Java Developer,React Developer,QA Engineer,DevOps Engineer,Data Engineer,Go Developer,System Analyst"
_WANTED = "Python,FastAPI,PostgreSQL|Java,Spring,Kafka|React,TypeScript,Redux|QA,Selenium,Postman|DevOps,Kubernetes,Terraform|Spark,Airflow,Kafka|Go,gRPC,PostgreSQL|SQL,BPMN,UML"
_OFFERED = "Python,Redis,FastAPI|Java,Spring,Hibernate|React,Redux,Next|QA,Postman,SQL|DevOps,Terraform,Ansible|Spark,Airflow,dbt|Go,Kafka,gRPC|SQL,UML,REST"

TABLES = {
    "vacancies": f"""SELECT s_suppkey AS id, concat('v', CAST(s_suppkey AS STRING)) AS synthetic_id,
  split_part('{_ROLES}', ',', CAST(s_suppkey % 8 AS INT) + 1) AS role,
  split(split_part('{_WANTED}', '|', CAST(s_suppkey % 8 AS INT) + 1), ',') AS stack,
  NULLIF(split_part('Junior,Middle,Middle+,Senior,Lead,', ',', CAST(s_suppkey % 6 AS INT) + 1), '') AS grade,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(1500 + (s_suppkey * 37 % 30) * 100 AS INT) END AS rate_max,
  split_part('Remote,Moscow,Moscow / Hybrid,RF,Berlin', ',', CAST(s_suppkey % 5 AS INT) + 1) AS location,
  concat('Company ', CAST(s_nationkey AS STRING)) AS company,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('Work of ', s_name) END AS description,
  concat('Vacancy ', s_name) AS original_text, s_suppkey % 17 = 0 AS is_strategic,
  CASE WHEN s_suppkey % 10 = 0 THEN 'closed' WHEN s_suppkey % 10 = 1 THEN 'hidden' ELSE 'active' END AS status,
  TIMESTAMP '2024-02-01 00:00:00' + CAST(s_suppkey % 40000 AS INT) * INTERVAL '1' MINUTE AS created_at,
  TIMESTAMP '2024-02-01 00:00:00' + CAST(s_suppkey * 7 % 41700 AS INT) * INTERVAL '1' MINUTE AS updated_at,
  CASE WHEN s_suppkey % 13 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS expires_at, e.embedding
  FROM supplier LEFT JOIN embeddings e ON e.vec_id = 2 * s_suppkey + 1""",
    "specialists": f"""SELECT c_custkey AS id, concat('s', CAST(c_custkey AS STRING)) AS synthetic_id,
  split_part('{_ROLES}', ',', CAST(c_custkey * 7 % 8 AS INT) + 1) AS role,
  split(split_part('{_OFFERED}', '|', CAST(c_custkey * 7 % 8 AS INT) + 1), ',') AS stack,
  NULLIF(split_part('Junior,Middle,Middle+,Senior,Lead,', ',', CAST(c_custkey % 6 AS INT) + 1), '') AS grade,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(1200 + (c_custkey * 53 % 35) * 100 AS INT) END AS rate_min,
  split_part('Remote,Moscow,RF,Kazan', ',', CAST(c_custkey % 4 AS INT) + 1) AS location,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('Profile of ', c_name) END AS description,
  concat('Bench ', c_name) AS original_text,
  CASE WHEN c_custkey % 10 = 0 THEN 'hired' WHEN c_custkey % 10 = 1 THEN 'hidden' ELSE 'active' END AS status,
  c_nationkey < 5 AS is_internal,
  TIMESTAMP '2024-02-01 00:00:00' + CAST(c_custkey % 40000 AS INT) * INTERVAL '1' MINUTE AS created_at,
  TIMESTAMP '2024-02-01 00:00:00' + CAST(c_custkey * 7 % 41700 AS INT) * INTERVAL '1' MINUTE AS updated_at,
  CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS expires_at, e.embedding
  FROM customer LEFT JOIN embeddings e ON e.vec_id = 2 * c_custkey""",
    "sources": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'vacancy' ELSE 'specialist' END AS entity_type,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(floor(o_custkey / 15) AS BIGINT) ELSE o_custkey END AS entity_id,
  o_orderkey % 20 AS channel_id, o_orderkey AS message_id, concat('chan', CAST(o_orderkey % 20 AS STRING)) AS chat_title,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('user', CAST(o_custkey % 100 AS STRING)) END AS sender_name,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('https://t.me/c/', CAST(o_orderkey % 20 AS STRING), '/', CAST(o_orderkey AS STRING)) END AS message_url,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('https://docs.google.com/spreadsheets/d/s', CAST(o_custkey % 50 AS STRING)) END AS external_url,
  CASE WHEN o_orderkey % 7 = 0 THEN 'google_sheet' END AS external_kind,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('Sheet1:', CAST(o_custkey % 40 AS STRING)) END AS external_locator,
  CASE o_orderstatus WHEN 'F' THEN 'telegram' WHEN 'O' THEN 'external_url' ELSE 'manual' END AS source_type,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('{"source_display":"Sheet ', CAST(o_custkey % 50 AS STRING), '"}') END AS source_meta,
  CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE concat(o_orderpriority, ' request') END AS raw_text,
  o_orderdate + CAST(o_orderkey % 1440 AS INT) * INTERVAL '1' MINUTE AS created_at FROM orders""",
    "registry": """SELECT concat('key', CAST(c_custkey AS STRING)) AS registry_key, concat('person', CAST(c_custkey % 400 AS STRING)) AS identity_key,
  concat('https://docs.google.com/spreadsheets/d/own', CAST(c_custkey % 3 AS STRING)) AS source_url,
  concat('Bench:', CAST(c_custkey AS STRING)) AS locator, c_custkey AS specialist_id, c_name AS raw_text,
  c_custkey % 4 <> 0 AS is_active FROM customer WHERE c_nationkey < 5""",
    "raw_messages": """SELECT conv_id % 20 AS channel_id, conv_id * 100 + turn AS message_id, concat('chan', CAST(conv_id % 20 AS STRING)) AS chat_title,
  CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('@chan', CAST(conv_id % 20 AS STRING)) END AS chat_username,
  CASE WHEN turn % 4 = 0 THEN NULL ELSE role END AS sender_name, text AS raw_text, ts AS message_date,
  CASE WHEN turn % 5 = 0 THEN ts + INTERVAL '10' MINUTE END AS edited_at, turn % 3 = 0 AS has_attachment,
  CASE WHEN turn % 3 = 0 THEN 'pdf' END AS attachment_type, TIMESTAMP '2024-02-01 00:00:00' AS created_at
  FROM conversations LEFT JOIN events ON event_id = conv_id * 8 + turn""",
    "channels": """SELECT DISTINCT conv_id % 20 AS telegram_id, concat('chan', CAST(conv_id % 20 AS STRING)) AS title,
  concat('@chan', CAST(conv_id % 20 AS STRING)) AS username,
  CASE WHEN conv_id % 20 % 3 = 0 THEN NULL WHEN conv_id % 2 = 0 THEN 'vacancy' ELSE 'chat' END AS source_kind,
  conv_id % 20 % 5 <> 0 AS is_active, conv_id % 20 * 100 AS last_message_id,
  TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id % 20 AS INT) * INTERVAL '1' HOUR AS added_at FROM conversations""",
    "matches": """SELECT CAST(floor(o_custkey / 15) AS BIGINT) AS vacancy_id, o_custkey AS specialist_id,
  CAST(max(o_orderkey % 1000) AS DOUBLE) / 1009 AS similarity_score, CAST(min(o_orderkey % 20) AS INT) + 1 AS rank,
  max(o_orderdate) AS created_at FROM orders GROUP BY CAST(floor(o_custkey / 15) AS BIGINT), o_custkey""",
    "jobs": """SELECT event_id AS id, event_type AS kind,
  CASE WHEN event_id % 4 = 0 THEN 'queued' WHEN event_id % 4 = 1 THEN 'processing' WHEN event_id % 4 = 2 THEN 'completed' ELSE 'failed' END AS status,
  props AS payload, user_id, ts AS created_at FROM events""",
    "posts": """SELECT o_orderkey AS id, o_custkey, concat_ws(chr(10),
  split_part('Ищем Java разработчика|Senior Python developer, remote|= Go 5 лет опыта|~ QA Lead|Вакансия: Аналитик|Анна Смирнова Java Developer Senior|С++ на бенче', '|', CAST(o_orderkey % 7 AS INT) + 1),
  split_part('Уровень: Senior|Опыт - 5 лет|Стек: Java, Kotlin|Требования: SQL|Обязанности - код|просто строка', '|', CAST(o_custkey % 6 AS INT) + 1),
  split_part('Ставка: 2500 RUB|rate 3000 rub|Опыт: 3 года|Контакт @user123|пишите a.b@example.com|https://x.example.com/cv.pdf|t.me/chan/15|Условия: офис', '|', CAST(o_orderkey % 8 AS INT) + 1),
  split_part('= второй|~ третий|- кейс java core|• анкета специалиста|доступны специалисты|подробные анкеты тут', '|', CAST(o_orderkey % 11 % 6 AS INT) + 1),
  CASE WHEN o_orderkey % 5 = 0 THEN 'Текст сообщения:' WHEN o_orderkey % 5 = 1 THEN 'Копия исходного сообщения' ELSE ' ' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Тип: bench' WHEN o_orderkey % 3 = 1 THEN 'Тип:  VACANCY' ELSE 'Тип: прочее' END,
  CASE WHEN o_orderkey % 10 = 5 THEN NULL ELSE concat('Заказ ', CAST(o_orderkey AS STRING), ' на 12.05.2024') END) AS text FROM orders""",
    "partners": """SELECT n_name AS canonical_name, CAST(n_nationkey * 7 % 5 AS BIGINT) AS mentions_count, CAST(NULL AS STRING) AS source_url FROM nation""",
}
_BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_ENTITY = "id bigint, synthetic_id string, role string, stack array<string>, grade string, {}location string, {}description string, original_text string, {}status string, {}created_at timestamp, updated_at timestamp, expires_at timestamp, embedding array<float>"
#: Explicit schemas of the entity tables, for files and databases.
SCHEMAS = {"vacancies": _ENTITY.format("rate_max int, ", "company string, ", "is_strategic boolean, ", ""), "specialists": _ENTITY.format("rate_min int, ", "", "", "is_internal boolean, ")}


def read_entities(spark: SparkSession, name: str, path: str | None = None, url: str | None = None, by: str = "id", parts: int = 16, **options: str) -> DataFrame:
    """An entity table with its explicit schema: from Parquet files, or from a database (lists and vectors as JSON text there), read in ``parts`` ranges of ``by`` if
    lowerBound and upperBound are given."""
    schema = SCHEMAS[name]
    if path:
        return spark.read.schema(schema).parquet(path)
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if "lowerBound" in options:
        reader = reader.options(partitionColumn=by, numPartitions=str(parts))
    rows = reader.load()
    return rows.selectExpr(*[f"from_json({n}, '{t}') AS {n}" if t.startswith("array") else f"CAST({n} AS {t}) AS {n}" for n, t in (c.split(" ", 1) for c in schema.split(", "))])


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """A domain or base table. dealt: its base rows (of these columns) are dealt evenly over the cluster first, for work that costs more than moving them."""
    deal = lambda rows: spread(rows.select(*columns) if columns else rows) if dealt else rows
    if name not in TABLES:
        return deal(base(spark, sf_dir, name))
    text = TABLES[name]
    used = [b for b in _BASE if re.search(rf"(FROM|JOIN) {b}\b", text)]
    for b in used:
        text = re.sub(rf"(FROM|JOIN) {b}\b(?! AS)", rf"\1 {{{b}}} AS {b}", text) if b != "embeddings" else text.replace("JOIN embeddings e", "JOIN {embeddings} AS e")
    # JSON braces in the text are no parameters
    text = text.replace('{"source_display"', '{{"source_display"').replace("'\"}'", "'\"}}'")
    return spark.sql(text, **{b: deal(base(spark, sf_dir, b)) for b in used})


def with_tables(body: str, *names: str) -> str:
    """SQL for the checks: the derived tables as common table expressions before ``body``."""
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in names) + "\n" + body
