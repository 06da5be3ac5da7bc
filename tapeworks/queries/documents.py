"""Nested JSON, term tables, check digits and post search."""
from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tapeworks.functions import text as T
from tapeworks.operators import documents as D
from tapeworks.queries import query
from tapeworks.session import ensure_checkpoint_dir
from tapeworks.sources import adapters as A

PARTS = ['{"a": [', ', {"b": "<script>x</script>", "javascript:c": "select it"}], "d": null, "e": {"f": {"g": [1, 2.5, true]}}}']
WIDE = "{" + ", ".join(f'"w{i}": "v{i}"' for i in range(40)) + "}"


def nested(s, d):
    e = A.table(s, d, "events")
    kind = F.col("event_id") % 5
    doc = F.when(kind == 0, F.col("props")).when(kind == 1, F.expr("substring(props, 1, length(props) - 1)")).when(kind == 2, F.concat(F.lit(PARTS[0]), "props", F.lit(PARTS[1]))).when(kind == 3, F.lit(WIDE))
    return e.select("event_id", doc.alias("doc"))


RULES = {k: v for k, v in T.THREATS.items()}
NODES = f"""j AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN left(props, length(props) - 1) WHEN 2 THEN '{PARTS[0]}' || props || '{PARTS[1]}' WHEN 3 THEN '{WIDE}' END AS doc FROM events),
g AS (SELECT event_id, doc FROM j WHERE doc IS NOT NULL AND json_valid(doc)),
n AS (SELECT event_id, t.type AS kind, t.key AS name, t.fullkey, t.atom, length(regexp_replace(t.fullkey, '[^.\\[]', '', 'g')) AS depth FROM g, json_tree(g.doc::JSON) t)"""


def _hits(p: str) -> str:
    p = p.replace("'", "''")
    return f"coalesce(regexp_matches(nm, '{p}'), false)::INT + coalesce(kind = 'VARCHAR' AND regexp_matches(sv, '{p}'), false)::INT"


@query("text_json_threats", f"""WITH {NODES}, m AS (SELECT *, CASE WHEN regexp_matches(fullkey, '\\]$') THEN NULL ELSE name::VARCHAR END AS nm, atom->>'$' AS sv FROM n),
a AS (SELECT event_id, max(depth)::INTEGER AS depth, count(*) AS n_values, count(*) FILTER (kind = 'VARCHAR') AS n_strings, {', '.join(f"sum({_hits(p)})::BIGINT AS threat_{k}" for k, p in RULES.items())},
  count(DISTINCT nm) FILTER (depth = 1 AND nm IN ('k', 'a')) AS have FROM m GROUP BY event_id)
SELECT event_id, doc IS NOT NULL AND n_values IS NULL AS malformed, coalesce(depth, 0) AS depth, coalesce(n_values, 0) AS n_values, coalesce(n_strings, 0) AS n_strings,
  {', '.join(f"coalesce(threat_{k}, 0) AS threat_{k}" for k in RULES)}, CASE WHEN n_values IS NOT NULL THEN 2 - have END AS n_missing FROM j LEFT JOIN a USING (event_id)""")
def _(s, d):
    """Depth, values, threats and missing fields of plain, cut, nested, wide and null documents made of event properties."""
    return D.json_threats(nested(s, d), "event_id", "doc", RULES, required=("k", "a"))


@query("text_json_nodes", f"""WITH {NODES} SELECT kind, depth::INTEGER AS depth, count(*) AS n FROM (SELECT CASE WHEN kind IN ('OBJECT', 'ARRAY') THEN kind WHEN kind = 'VARCHAR' THEN 'STRING' WHEN kind = 'NULL' THEN 'VOID' WHEN kind = 'BOOLEAN' THEN kind WHEN kind = 'DOUBLE' THEN 'DECIMAL' ELSE 'BIGINT' END AS kind, depth FROM n) GROUP BY ALL""")
def _(s, d):
    """Values of the same documents by kind and depth."""
    return D.walk_json(nested(s, d), "event_id", "doc").groupBy("kind", "depth").agg(F.count(F.lit(1)).alias("n"))


SQL_TERMS = "terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM benchmark)"


@query("text_term_table", f"WITH {SQL_TERMS} SELECT doc_id AS id, term, CAST(strpos(lower(text), term) AS BIGINT) AS first FROM documents JOIN terms ON contains(lower(text), term)")
def _(s, d):
    """Which words of the benchmark stand in each document, also inside longer words, and where first."""
    terms = A.table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("term"))
    docs = A.table(s, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return D.find_terms(docs, "doc_id", "text", terms, most_chars=2_000).select("id", "term", "first")


_DIGITS = "list_transform(string_split(reverse(regexp_replace(x, '[^0-9]', '', 'g')), ''), lambda c: c::INT)"
_LUHN = f"list_sum(list_transform({_DIGITS}, lambda v, i: CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END)) % 10 = 0"


@query("text_checked_numbers", rf"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '{D.CARD_RUN}') AS xs FROM documents),
l AS (SELECT doc_id, unnest(xs) AS x FROM r), k AS (SELECT doc_id, count(*) AS n FROM l WHERE {_LUHN} GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_cards FROM documents LEFT JOIN k USING (doc_id)""")
def _(s, d):
    """Card numbers whose check digit holds."""
    cards, _accounts = D.checked_numbers("text")
    return A.table(s, d, "documents").select("doc_id", F.size(cards).alias("n_cards"))


@query("post_search_hours", "SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7) AS ts FROM documents WHERE TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7) > TIMESTAMP '2024-01-04 12:30:00' - INTERVAL 48 HOUR AND TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7) <= TIMESTAMP '2024-01-04 12:30:00' AND contains(lower(text), 'the thsh')"
       " UNION ALL SELECT doc_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7) FROM documents WHERE TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7) > TIMESTAMP '2024-01-05 01:00:00' - INTERVAL 90 HOUR AND TIMESTAMP '2024-01-01' + to_minutes(doc_id * 7) <= TIMESTAMP '2024-01-05 01:00:00' AND contains(lower(text), 'ción')")
def _(s, d):
    """Documents as posts seven minutes apart: two needles in the last 48 and 90 hours, from a stored index."""
    ensure_checkpoint_dir(s)
    start = F.lit("2024-01-01").cast("timestamp")
    posts = A.table(s, d, "documents").select(F.col("doc_id").alias("id"), (start + F.make_interval(mins=(F.col("doc_id") * 7).cast("int"))).alias("ts"), "text")
    index = D.PostIndex.build(posts, f"{s.sparkContext.getCheckpointDir()}/posts-{uuid4().hex}")
    return index.search("the thsh", "2024-01-04 12:30:00", 48).unionByName(index.search("ción", "2024-01-05 01:00:00", 90)).select("id", "ts")
