"""SQL twins of the pN_ queries that SQL can express."""

SQL: dict[str, str] = {
    "p2_found": r"""
WITH d AS (SELECT DISTINCT pair_id, regexp_extract_all(lower(coalesce(input, '') || ' ' || coalesce(output, '')), '[\p{L}\p{Nd}]+') AS w FROM synthetic_sft),
s AS (SELECT DISTINCT pair_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d WHERE len(w) >= 30),
n AS (SELECT pair_id, count(*) AS n FROM s GROUP BY 1),
j AS (SELECT a.pair_id AS a, b.pair_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.pair_id < b.pair_id GROUP BY 1, 2)
SELECT a AS pair_id_a, b AS pair_id_b FROM j JOIN n x ON x.pair_id = a JOIN n y ON y.pair_id = b WHERE k >= 0.6::DOUBLE * (x.n + y.n - k)""",
}
