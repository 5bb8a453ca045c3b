"""The catalogue derived from the synthetic tables: one statement that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import OWNER_MOST, REPO_MOST, repository_path_sql

#: {documents}, {part} and {pages} stand for the tables.
PROJECTS_SQL = r"""
WITH src AS (
  SELECT d.doc_id AS k, d.text, d.lang, d.source, p.p_name, g.url
  FROM {documents} d
  JOIN {part} p ON p.p_partkey = d.doc_id
  JOIN {pages} g ON g.page_id = d.doc_id % 50
), raw AS (
  SELECT CAST(k AS INT) AS id,
    concat('rec', lpad(CAST(k AS STRING), 8, '0')) AS airtable_id,
    source AS ysws,
    CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(1700000000 + k * 3600 AS BIGINT) END AS approved_at,
    CASE k % 7 WHEN 0 THEN concat('https://example.com/user', CAST(k % 97 AS STRING), '/', replace(p_name, ' ', '-'), '.git')
               WHEN 1 THEN concat('git@example.com:user', CAST(k % 97 AS STRING), '/', replace(p_name, ' ', '_'), '.git')
               WHEN 2 THEN concat('https://example.com/user', CAST(k % 97 AS STRING), '/', replace(p_name, ' ', '-'), '/')
               WHEN 3 THEN NULL
               WHEN 4 THEN concat('example.com/user', CAST(k % 97 AS STRING), '/', replace(p_name, ' ', '-'))
               WHEN 5 THEN concat('https://example.com/user', CAST(k % 97 AS STRING), '/', replace(p_name, ' ', '_'), '/tree/main')
               ELSE concat('HTTPS://example.com/user', CAST(k % 97 AS STRING), '/', replace(p_name, ' ', '-')) END AS code_url,
    CASE WHEN k % 5 = 0 THEN NULL ELSE lang END AS country,
    CASE WHEN k % 4 = 0 THEN NULL ELSE url END AS demo_url,
    CASE WHEN k % 13 = 0 THEN NULL ELSE text END AS description,
    CASE WHEN k % 3 = 0 THEN NULL ELSE concat('user', CAST(k % 97 AS STRING)) END AS github_username,
    CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(k % 40 AS INT) END AS hours,
    CASE WHEN k % 8 = 0 THEN NULL ELSE CAST(k % 400 AS DOUBLE) / 10 END AS true_hours,
    CASE WHEN k % 9 = 0 THEN NULL ELSE concat('https://media.example.com/', CAST(k AS STRING), '.png') END AS media_url,
    CAST(k % 50 AS INT) AS github_stars,
    CASE WHEN k % 10 = 0 THEN NULL ELSE p_name END AS display_name,
    CASE WHEN k % 2 = 0 THEN NULL ELSE concat('https://archive.example.com/demo/', CAST(k AS STRING)) END AS archived_demo,
    CASE WHEN k % 2 = 1 THEN NULL ELSE concat('https://archive.example.com/repo/', CAST(k AS STRING)) END AS archived_repo,
    CAST('2024-01-01 00:00:00' AS TIMESTAMP) + k * INTERVAL '1' MINUTE AS created_at,
    CASE WHEN k % 17 = 0 THEN CAST('2024-06-01 00:00:00' AS TIMESTAMP) ELSE NULL END AS deleted_at
  FROM src
), path AS (
  SELECT *, <path> AS repo_path
  FROM raw
)
SELECT id, airtable_id, ysws, approved_at, code_url, country, demo_url, description, github_username, hours, true_hours,
  media_url, media_url IS NOT NULL AS has_media, github_stars, display_name, archived_demo, archived_repo, created_at,
  created_at AS updated_at, deleted_at,
  CASE WHEN length(split_part(repo_path, '/', 1)) BETWEEN 1 AND <owner> THEN split_part(repo_path, '/', 1) END AS inferred_username,
  CASE WHEN length(split_part(repo_path, '/', 2)) BETWEEN 1 AND <repo> THEN split_part(repo_path, '/', 2) END AS inferred_repo
FROM path
"""
PROJECTS_SQL = PROJECTS_SQL.replace("<path>", repository_path_sql("coalesce(code_url, '')")).replace("<owner>", str(OWNER_MOST)).replace("<repo>", str(REPO_MOST))
EMBEDDINGS_SQL = "SELECT CAST(vec_id AS INT) AS project_id, embedding, 'fixture' AS model FROM {embeddings}"


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(PROJECTS_SQL, documents=read("documents"), part=read("part"), pages=read("pages"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EMBEDDINGS_SQL, embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(body: str) -> str:
    """SQL over projects, live and project_embeddings, for DuckDB."""
    views = PROJECTS_SQL.format(documents="documents", part="part", pages="pages")
    vectors = EMBEDDINGS_SQL.format(embeddings="embeddings")
    return f"WITH projects AS ({views}), live AS (SELECT * FROM projects WHERE deleted_at IS NULL), project_embeddings AS ({vectors}) {body}"
