"""Views of the given tables in the shapes of the engine's inputs. The text runs in Spark and in DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SEV = "CASE WHEN severity_score >= 9 THEN 'Critical' WHEN severity_score >= 7 THEN 'High' WHEN severity_score >= 4 THEN 'Medium' ELSE 'Low' END"

#: Tables in braces are the given ones.
ADAPTERS = {
    "findings": f"""SELECT *, {_SEV} AS severity, concat('Issue ', rule_id) AS title FROM (
SELECT o_orderkey AS id, o_orderkey % 1500 AS scan_id, concat('src/f', cast(o_custkey % 97 as varchar(64)), '.py') AS file,
  CAST(o_orderkey % 50 AS INT) + 1 AS line, concat('R-', cast(o_custkey % 20 as varchar(64))) AS rule_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'python-heuristic' WHEN 1 THEN 'web-heuristic' ELSE 'bandit' END AS scanner,
  CASE o_custkey % 6 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'CWE-79' WHEN 2 THEN 'CWE-78' WHEN 3 THEN 'CWE-798' WHEN 4 THEN 'CWE-330' ELSE '' END AS cwe,
  CASE CAST(floor(o_totalprice) AS BIGINT) % 40 WHEN 0 THEN 9 WHEN 1 THEN 7 WHEN 2 THEN 5 WHEN 3 THEN 5 ELSE 2 END AS severity_score
FROM {{orders}}) x""",
    "detections": """SELECT l_orderkey % 50 AS scan_id, concat('src/f', cast(l_partkey % 7 as varchar(64)), '.py') AS file, l_linenumber AS line,
  concat('R-', cast(l_suppkey % 5 as varchar(64))) AS rule_id, l_returnflag AS scanner, CAST(floor(l_quantity) AS INT) % 10 AS severity_score FROM {lineitem}""",
    "scans": """SELECT o_orderkey AS id, o_custkey AS project_id, o_orderdate AS started_at,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INT) AS security_score, 1 + o_orderkey % 40 AS files_scanned FROM {orders}""",
    "projects": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS language FROM {customer}",
    "recommendations": """SELECT o_orderkey * 10 + k AS id, o_orderkey AS finding_id, concat('fix ', cast(k as varchar(8))) AS recommended_fix
FROM {orders} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) v WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "code": """SELECT c_custkey AS file_id, CASE c_custkey % 8
  WHEN 0 THEN concat('password = "', c_name, '"') WHEN 1 THEN 'subprocess.run(cmd, shell=True)'
  WHEN 2 THEN 'data = pickle.loads(blob)' WHEN 3 THEN concat('h = hashlib.md5(x)  # ', c_mktsegment)
  WHEN 4 THEN concat('# password = "', c_name, '"') WHEN 5 THEN concat('password = "test', c_name, '"')
  WHEN 6 THEN 'r = requests.get("http://example.org/a")' ELSE concat('x = ', cast(c_custkey as varchar(64))) END AS line FROM {customer}""",
    "requests": """SELECT event_id, ts, concat('10.0.0.', cast(user_id % 5 as varchar(8))) AS client,
  CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login_ok' ELSE 'request' END AS kind FROM {events}""",
    "truth": "SELECT doc_id AS file_id, concat('R-', cast(quality as varchar(4))) AS rule_id FROM {labels}",
    "predicted": "SELECT doc_id AS file_id, concat('R-', cast(n_chars % 2 as varchar(4))) AS rule_id FROM {documents} WHERE n_chars >= 400",
    "paths": """SELECT c_custkey AS file_id, c_custkey * 3000 AS length, concat(CASE c_custkey % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN '.GIT/'
  WHEN 3 THEN 'a/b/c/d/e/f/g/h/i/j/k/' WHEN 4 THEN 'lib/' ELSE '' END, 'f', cast(c_custkey as varchar(64)), CASE c_custkey % 10 WHEN 0 THEN '.py' WHEN 1 THEN '.JS'
  WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.java' WHEN 4 THEN '.sh' WHEN 5 THEN '' WHEN 6 THEN '.kt' WHEN 7 THEN '.html' WHEN 8 THEN '.css' ELSE '.hpp' END) AS path FROM {customer}""",
    "issues": """SELECT concat('s', cast(o_orderkey % 1500 as varchar(64))) AS scan_id, o_orderkey AS id, concat('src/f', cast(o_custkey % 97 as varchar(64)), '.py') AS file,
  CAST(o_orderkey % 50 AS INT) + 1 AS line, CASE o_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'odd' END AS sev,
  concat('R', cast(o_custkey % 20 as varchar(64))) AS rule, concat('message ', cast(o_orderkey as varchar(64))) AS msg, CAST(o_custkey % 11 AS DOUBLE) AS cvss FROM {orders}""",
    "ports": """SELECT concat('s', cast(o_orderkey % 1500 as varchar(64))) AS scan_id, concat('h', cast(o_orderkey % 1500 as varchar(64))) AS host, o_orderkey AS id,
  CASE o_custkey % 12 WHEN 0 THEN 21 WHEN 1 THEN 22 WHEN 2 THEN 23 WHEN 3 THEN 80 WHEN 4 THEN 443 WHEN 5 THEN 445 WHEN 6 THEN 3306 WHEN 7 THEN 6379 WHEN 8 THEN 27017
  WHEN 9 THEN 8080 WHEN 10 THEN 9999 ELSE 4444 END AS port,
  CASE o_orderkey % 6 WHEN 0 THEN 'OpenSSH_7.4' WHEN 1 THEN 'Apache/2.4' WHEN 2 THEN 'nginx/1.19' WHEN 3 THEN 'OpenSSL/1.1' WHEN 4 THEN 'Postfix' ELSE '' END AS banner FROM {orders}""",
}


#: Views whose rows become files that rules are matched over, at far more cost than reading them.
SPREAD = ("code",)


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over as many tasks as a shuffle has. A row group of narrow rows is one task, even where each row becomes a file."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *rows.columns[:1])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = ADAPTERS[name]
    tables = set(re.findall(r"\{(\w+)\}", sql))
    rows = spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
    return spread(rows) if name in SPREAD else rows


def duck(name: str) -> str:
    """The adapter as DuckDB runs it."""
    return re.sub(r"\{(\w+)\}", r"\1", ADAPTERS[name])
