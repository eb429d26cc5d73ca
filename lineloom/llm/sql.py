"""DuckDB SQL of the operators that SQL can express, for comparison with the queries' results."""

from __future__ import annotations


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def _apportion(name: str, parties: str, group: str, party: str, weight: str, seats: str, most: str) -> str:
    """Seats by the highest quotients, all of them dealt one by one within each group."""
    return (
        f"{name}_seat AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {weight} / (2 * seat + 1) DESC, {party}, seat) AS rank FROM (SELECT *, unnest(range(least({most}, 2 * {seats} + 2))) AS seat FROM {parties}) WHERE {weight} > 0), "
        f"{name} AS (SELECT p.*, coalesce(w.quota, 0) AS quota FROM {parties} p LEFT JOIN (SELECT {group} AS g, {party} AS k, count(*) AS quota FROM {name}_seat WHERE rank <= {seats} GROUP BY ALL) w ON p.{group} IS NOT DISTINCT FROM w.g AND p.{party} IS NOT DISTINCT FROM w.k)"
    )


_MIX = f"""
WITH counts AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM counts GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS most FROM by_source),
levels AS (SELECT *, most::DOUBLE / weight AS full_at, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, place, source_size, least(most::DOUBLE, (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, place LIMIT 1) * weight) AS target FROM levels),
blocks AS (SELECT *, coalesce((SELECT greatest(1, least(256, floor(min(target) / 200)))::BIGINT FROM targets WHERE target > 0), 1) AS block FROM targets),
parties AS (SELECT *, round(sum(source_size) OVER () / block)::BIGINT AS seats, 3 * ceil(source_size / block)::BIGINT AS most, 1 AS one, greatest(1, ceil(source_size / 1048576))::BIGINT AS shards FROM blocks),
{_apportion("quotas", "parties", "one", "place", "target", "seats", "most")},
dealt AS (SELECT c.*, q.place, q.source_size, q.target, q.block, q.quota AS source_quota, {_draw("'42'", "coalesce(doc_id::VARCHAR, '')")} % q.shards AS shard, md5(concat_ws('|', '42-order', coalesce(doc_id::VARCHAR, ''))) AS turn FROM counts c JOIN quotas q ON c.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT place, shard, any_value(source) AS source, any_value(block) AS block, any_value(source_quota) AS source_quota, ceil(sum(size) / any_value(block))::BIGINT AS blocks, 3 * ceil(sum(size) / any_value(block))::BIGINT AS most, sum(size)::DOUBLE AS weight FROM dealt GROUP BY place, shard),
{_apportion("shares", "shards", "place", "shard", "weight", "source_quota", "most")},
runs AS (SELECT place, shard, quota // blocks AS passes, {_draw("'42-start'", "coalesce(source, '')", "shard::VARCHAR")} % blocks * block AS lo, quota % blocks * block AS run, blocks * block AS around FROM shares WHERE blocks > 0),
placed AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM dealt)
SELECT doc_id, size, source_size, target, coalesce(size * passes + greatest(0, least(stop, lo + run) - greatest(stop - size, lo)) + greatest(0, least(stop, lo + run - around) - greatest(stop - size, 0)), 0)::BIGINT AS taken
FROM placed LEFT JOIN runs USING (place, shard)
"""

_EMBEDDINGS = """
WITH RECURSIVE usable AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, e.vec_id = c AS kept FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM pair GROUP BY a) l ON l.a = e.vec_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id
"""

ORACLE: dict[str, str] = {"op3_embeddings": _EMBEDDINGS, "op7_mixing": _MIX}
