"""The fixture views as SQL text (FIXTURES.md §3), used by the DuckDB oracle.

Fixed values: these four statements define the test inputs and must stay as written.
"""

TICKETS = """
SELECT o.o_orderkey AS ticket_id,
       CAST(18 + c.c_custkey % 53 AS INT) AS customer_age,
       c.c_mktsegment AS customer_gender,
       p.p_brand AS product_purchased,
       CAST(o.o_orderdate AS DATE) AS date_of_purchase,
       p.p_type AS ticket_type,
       d.source AS ticket_subject,
       d.text AS ticket_description,
       o.o_orderstatus AS ticket_status,
       CASE WHEN o.o_orderstatus = 'F' THEN p.p_name END AS resolution,
       o.o_orderpriority AS ticket_priority,
       d.lang AS ticket_channel,
       o.o_orderdate AS first_response_time,
       l.ship AS time_to_resolution,
       CASE WHEN o.o_orderstatus = 'F' THEN CAST(1 + o.o_custkey % 5 AS DOUBLE) END AS customer_satisfaction_rating
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)
JOIN documents d ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""

PRICES = """
SELECT o_orderstatus AS ticker, CAST(o_orderdate AS DATE) AS date,
       min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
       max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume
FROM orders GROUP BY o_orderstatus, CAST(o_orderdate AS DATE)
"""

NEWS = """
SELECT d.doc_id, l.quality AS gold, d.text,
       CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 = 7 THEN 'valid' ELSE 'test' END AS split
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

VECTORS = """
SELECT vec_id, embedding, label, CASE WHEN label < 3 THEN 1 ELSE 0 END AS gold,
       CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 = 7 THEN 'valid' ELSE 'test' END AS split
FROM embeddings
"""

VIEWS = {"tickets": TICKETS, "prices": PRICES, "news": NEWS, "vectors": VECTORS}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the fixture views it uses (in dependency order)."""
    used = [n for n in ("tickets", "prices", "news", "vectors") if n in names]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
