"""Domain relations as projections of the star-schema tables.

Each relation is one SQL text that Spark and DuckDB both read, so queries and their SQL see
the same rows. Every relation has holes (nulls by modulus) for the rules on missing values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.sources import samples

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "bank": """
        SELECT concat('B', CAST(s_suppkey AS STRING)) AS bank_code, s_name AS bank_name,
               CASE n_regionkey WHEN 0 THEN 'CA' WHEN 1 THEN 'US' WHEN 2 THEN 'JP' WHEN 3 THEN 'KR' ELSE 'GB' END AS country_code,
               CASE WHEN s_suppkey % 9 = 0 THEN 'inactive' ELSE 'active' END AS status,
               concat('https://www.bank', CAST(s_suppkey AS STRING), '.example.com/') AS homepage_url
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "product": """
        SELECT concat('P', CAST(p_partkey AS STRING)) AS product_id, concat('B', CAST(p_partkey % 10 AS STRING)) AS bank_code, bank_name, country_code,
               CASE WHEN p_type IN ('PROMO', 'ECONOMY', 'MEDIUM') THEN 'deposit' ELSE 'lending' END AS product_family,
               CASE p_type WHEN 'PROMO' THEN 'chequing' WHEN 'ECONOMY' THEN 'savings' WHEN 'MEDIUM' THEN 'gic' WHEN 'SMALL' THEN 'mortgage' WHEN 'LARGE' THEN 'credit-card' ELSE 'personal-loan' END AS product_type,
               CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'standard' WHEN p_size % 3 = 1 THEN 'package' ELSE 'premium' END AS subtype_code,
               p_name AS product_name, CASE WHEN p_partkey % 7 = 0 THEN 'inactive' ELSE 'active' END AS status,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey * 37 % 500 AS DOUBLE) / 100 END AS direct_rate,
               CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey * 11 % 700 AS DOUBLE) / 100 ELSE NULL END AS posted_rate,
               CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size * 13 % 25 AS DOUBLE) END AS display_fee,
               CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE CAST(p_size * 7 % 20 AS DOUBLE) END AS monthly_fee,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size * 100 % 6000 AS DOUBLE) END AS minimum_balance,
               CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_size * 150 % 7000 AS DOUBLE) END AS minimum_deposit,
               CASE WHEN p_type = 'MEDIUM' THEN p_size * 30 ELSE NULL END AS term_length_days,
               CASE p_partkey % 5 WHEN 0 THEN 'student,newcomer' WHEN 1 THEN 'senior' WHEN 2 THEN '' WHEN 3 THEN 'youth,student' ELSE NULL END AS tags,
               CAST('2026-01-01' AS DATE) + CAST(p_partkey * 7 % 120 AS INT) AS last_changed_on
        FROM {part} JOIN {bank} ON concat('B', CAST(p_partkey % 10 AS STRING)) = bank_code""",
    "version": """
        SELECT concat('P', CAST(l_partkey AS STRING)) AS product_id, concat('V', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS version_id,
               row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS version_no,
               l_shipdate AS approved_at, l_quantity AS rate_value, l_returnflag AS note
        FROM {lineitem}""",
    "run": """
        SELECT concat('R', CAST(o_orderkey AS STRING)) AS run_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'started' END AS run_state,
               CASE WHEN o_orderkey % 3 = 0 THEN 'scheduled' WHEN o_orderkey % 3 = 1 THEN 'manual' ELSE NULL END AS trigger_type,
               concat('U', CAST(o_custkey AS STRING)) AS triggered_by, o_orderdate AS started_at,
               CASE WHEN o_orderkey % 4 = 0 THEN true ELSE false END AS partial_flag,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('C', CAST(o_custkey % 40 AS STRING)) END AS schedule_key
        FROM {orders}""",
    "run_item": """
        SELECT concat('R', CAST(l_orderkey AS STRING)) AS run_id, l_linenumber AS item_no, CASE l_linestatus WHEN 'O' THEN 'completed' ELSE 'failed' END AS stage_status,
               CASE l_returnflag WHEN 'A' THEN 'fetch' WHEN 'N' THEN 'parse' ELSE 'extract' END AS stage_name, l_shipdate AS started_at,
               CAST(l_quantity AS BIGINT) % 4 AS error_count, CAST(l_discount * 100 AS BIGINT) % 3 AS warning_count
        FROM {lineitem}""",
    "task": """
        SELECT concat('T', CAST(o_orderkey AS STRING)) AS task_id, concat('N', CAST(o_orderkey AS STRING)) AS candidate_id, concat('R', CAST(o_orderkey % 50 AS STRING)) AS run_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'queued' WHEN '2-HIGH' THEN 'deferred' WHEN '3-MEDIUM' THEN 'approved' WHEN '4-NOT SPECIFIED' THEN 'rejected' ELSE 'edited' END AS review_state,
               CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'P' THEN 'warning' ELSE 'pass' END AS validation_status,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) / 100 END AS confidence,
               c_name AS product_name, c_mktsegment AS product_type, concat('B', CAST(o_custkey % 10 AS STRING)) AS bank_code, o_orderdate AS created_at
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "usage": """
        SELECT event_id AS usage_id, ts AS recorded_at, concat('R', CAST(user_id AS STRING)) AS run_id, event_type AS agent_name,
               CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider_name, concat('m', CAST(user_id % 5 AS STRING)) AS model_name,
               CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('N', CAST(event_id % 200 AS STRING)) END AS candidate_id,
               CASE WHEN event_id % 40 = 0 THEN 0 ELSE event_id * 31 % 900 END AS prompt_tokens, CASE WHEN event_id % 40 = 0 THEN 0 ELSE event_id * 17 % 300 END AS completion_tokens,
               CAST(event_id * 13 % 1000 AS BIGINT) AS cost_micros
        FROM {events}""",
    "refresh": """
        SELECT concat('S', CAST(o_orderkey AS STRING)) AS snapshot_id, CASE WHEN o_orderkey % 5 = 0 THEN 'internal' ELSE 'public' END AS refresh_scope,
               CASE o_custkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'US' WHEN 2 THEN 'JP' ELSE 'KR' END AS country_code,
               CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' ELSE 'started' END AS refresh_status, o_orderdate AS attempted_at,
               CASE WHEN o_orderstatus = 'O' THEN o_orderdate ELSE NULL END AS refreshed_at
        FROM {orders}""",
    "change": """
        SELECT concat('E', CAST(o_orderkey AS STRING)) AS change_id, concat('P', CAST(o_custkey AS STRING)) AS product_id,
               CASE WHEN o_orderkey % 7 = 0 THEN 'ManualOverride' WHEN o_orderstatus = 'O' THEN 'New' WHEN o_orderstatus = 'F' THEN 'Updated' ELSE 'Discontinued' END AS event_type,
               o_orderdate AS detected_at, CASE WHEN o_orderkey % 3 = 0 THEN 'rate,fee' WHEN o_orderkey % 3 = 1 THEN 'rate' ELSE '' END AS changed_fields
        FROM {orders}""",
    "offer": """
        SELECT concat('P', CAST(k AS STRING)) AS product_id, family AS product_family, kind AS product_type, shown AS display_rate, CAST('2026-04-13' AS DATE) AS reference_date,
               CASE k % 14
                 WHEN 0 THEN concat('Earn up to ', r, '% interest rate for the first 3 months. Limited time offer.')
                 WHEN 1 THEN concat('**Interest rate**: ', r, '% APR. A purchase rate of ', s, '% may apply.')
                 WHEN 2 THEN concat('Rates from ', r, '% APR to ', s, '% for qualified borrowers, interest rate varies')
                 WHEN 3 THEN concat('The full term return is ', r, '% of the original investment,  not an annual rate')
                 WHEN 4 THEN concat('Offer valid until March ', CAST(1 + k % 28 AS STRING), ', ', CAST(2025 + k % 3 AS STRING), '. Promotional rate of ', r, '%')
                 WHEN 5 THEN concat('Redeem as much as ', r, '% of principal each year')
                 WHEN 6 THEN concat(r, '% intro APR for 12 months, then a variable rate of ', s, '% APR')
                 WHEN 7 THEN 'Annual percentage rate {{{{rate}}}}% applies; see xx.xx%'
                 WHEN 8 THEN concat('Offer valid from January 3 through Feb ', CAST(1 + k % 28 AS STRING), 'th, 2025. Earn a savings rate of ', r, '% for 6 months')
                 WHEN 9 THEN concat('Variable mortgage rate of prime + ', r, '%; minimum down payment ', s, '%')
                 WHEN 10 THEN concat('1 year ', r, '% 2 years ', s, '% 90 days 1.5%')
                 WHEN 11 THEN concat(r, '% for 6 months, ', s, '% for 1.5 years, 3% for 2 years')
                 WHEN 12 THEN concat('Term Rate (%) APY (%): 1 year ', r, '% ', s, '% 2 years 2% 2.05%')
                 ELSE NULL END AS offer_text
        FROM (SELECT p_partkey AS k, CASE WHEN p_type IN ('PROMO', 'ECONOMY', 'MEDIUM') THEN 'deposit' ELSE 'lending' END AS family, CASE p_type WHEN 'SMALL' THEN 'mortgage' WHEN 'LARGE' THEN 'credit-card' WHEN 'MEDIUM' THEN 'gic' ELSE 'other' END AS kind,
                     CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_partkey * 37 % 12000 AS DOUBLE) / 100 END AS shown, concat(CAST(p_partkey % 13 AS STRING), '.', CAST(10 + p_size % 40 AS STRING)) AS r, concat(CAST(p_size % 29 AS STRING), '.', CAST(10 + p_partkey % 80 AS STRING)) AS s
              FROM {part})""",
    "payload": """
        SELECT concat('P', CAST(p_partkey AS STRING)) AS product_id,
               concat('{{"rate": "', CAST(p_size % 12 AS STRING), '.5", "fee": ', CAST(p_partkey % 20 AS STRING), ', "name": "', p_name, '", "flags": ["', CASE p_partkey % 3 WHEN 0 THEN 'online", "branch' WHEN 1 THEN 'phone' ELSE 'online", "phone", "app' END, '"]}}') AS payload,
               CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{{}}' ELSE concat('{{"rate": "', CAST(p_size % 9 AS STRING), '.25", "note": "v', CAST(p_partkey % 5 AS STRING), '"}}') END AS version_payload,
               concat('[{{"name": "rate", "value": "', CAST(p_size % 12 AS STRING), '.5"}}, {{"name": "fee", "value": "', CASE WHEN p_partkey % 6 = 0 THEN 'none' ELSE CAST(p_partkey % 20 AS STRING) END, '"}}', CASE WHEN p_partkey % 2 = 0 THEN ', {{"name": "term"}}' ELSE '' END, ']') AS fields,
               concat('2026-0', CAST(1 + p_size % 9 AS STRING), '-', CAST(10 + p_partkey % 18 AS STRING), CASE p_partkey % 3 WHEN 0 THEN 'T10:30:00Z' WHEN 1 THEN ' 08:00:00' ELSE 'T23:59:59+00:00' END) AS verified_at
        FROM {part}""",
    "captured": """
        SELECT concat('P', CAST(p_partkey AS STRING)) AS product_id,
               concat('{{"product_name": ', CASE p_partkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '7' ELSE concat('"', p_name, '"') END, ', "monthly_fee": ', CASE p_partkey % 5 WHEN 0 THEN '"free"' WHEN 1 THEN '12' WHEN 2 THEN '9.95' WHEN 3 THEN '{{"amount": 4}}' ELSE 'true' END,
                      ', "term_length_days": ', CASE p_partkey % 3 WHEN 0 THEN '365' WHEN 1 THEN '365.5' ELSE '"1 year"' END, ', "redeemable_flag": ', CASE p_partkey % 7 WHEN 0 THEN '"yes"' WHEN 1 THEN '1' ELSE 'false' END,
                      ', "term_rate_table": ', CASE p_partkey % 2 WHEN 0 THEN '[{{"rate": 4}}]' ELSE '"4% for a year"' END, ', "regular_interest_rate": ', CASE p_partkey % 6 WHEN 0 THEN '"2.5%"' ELSE '2.5' END, ', "other": {{"a": [1, "b"]}}}}',
                      CASE p_partkey % 11 WHEN 0 THEN ' and more' ELSE '' END) AS payload
        FROM {part}""",
    "component_page": """
        SELECT page_id, url, concat(coalesce(html, ''), '<script type="application/json">{{"products": [{{"title": "Product ', CAST(page_id AS STRING), '", "cta": {{"targetUrl": "/products/', CAST(page_id % 50 AS STRING), '/"}}}}, {{"name": "Card ', CAST(page_id % 7 AS STRING),
                      '", "learnMore": {{"path": "cards/', CAST(page_id % 20 AS STRING), '/"}}, "monthlyFee": "$', CAST(page_id % 9 AS STRING), '"}}]}}</script><div data-cardname="Visa ', CAST(page_id % 5 AS STRING), '" data-cardurl="/content/site/visa-', CAST(page_id % 5 AS STRING), '.html"></div>') AS html
        FROM {pages}""",
    "registered": """
        SELECT page_id AS source_id, concat('https://www.bank.example/p', CAST(page_id AS STRING), CASE WHEN page_id % 9 = 4 THEN '.pdf' ELSE '' END) AS url, CASE WHEN page_id % 9 = 4 THEN 'pdf' ELSE 'html' END AS source_type,
               CASE WHEN page_id % 40 = 0 THEN 'entry' WHEN page_id % 9 = 4 THEN 'supporting' ELSE 'detail' END AS role
        FROM {pages} WHERE page_id % 7 <> 6""",
    "site_link": """
        SELECT concat('https://www.bank.example/p', CAST(page_id AS STRING)) AS from_url,
               CASE k WHEN 0 THEN concat('https://www.bank.example/p', CAST(page_id * 2 + 1 AS STRING), CASE WHEN (page_id * 2 + 1) % 9 = 4 THEN '.pdf' ELSE '' END) WHEN 1 THEN concat('https://www.bank.example/p', CAST(page_id + 3 AS STRING)) WHEN 2 THEN concat('https://www.bank.example/compare/p', CAST(page_id % 5 AS STRING))
                 WHEN 3 THEN CASE page_id % 4 WHEN 0 THEN 'https://other.example/offers/x' WHEN 1 THEN 'https://other.example/x' WHEN 2 THEN 'https://secure.bank.example/login' ELSE NULL END ELSE concat('https://www.bank.example/p', CAST(page_id AS STRING)) END AS target_url
        FROM {pages} JOIN (VALUES (0), (1), (2), (3), (4)) AS listed (k) ON true""",
    "listing": """
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'credit-card' WHEN 1 THEN 'line-of-credit' ELSE 'mortgage' END AS product_type,
               concat('<main><h1>Overview</h1><p>Annual fee: $1</p><p>Purchase rate: 9%</p><h2>Gold ', CAST(page_id % 11 AS STRING), '</h2><p>Annual fee: $', CAST(page_id % 130 AS STRING), '</p><p>', CASE page_id % 4 WHEN 0 THEN 'No rate' ELSE 'Purchase rate: 19.99%' END,
                      '</p><p>A rate of prime</p><p>Secured by home equity</p><p>Limit of $', CAST(page_id AS STRING), '</p><p>Interest only</p><h2>Silver</h2><p>Annual fee: $0</p><p>Purchase APR 20.5 %</p><h3>', CASE page_id % 5 WHEN 0 THEN 'Silver' ELSE 'Student Line' END,
                      '</h3><p>Rate: 7%</p><p>Unsecured</p><p>Your limit depends</p><p>Minimum payment: 3%</p><p>No annual fee</p></main>') AS html
        FROM {pages}""",
    "profiled": """
        SELECT concat('P', CAST(p_partkey AS STRING)) AS product_id, CASE p_partkey % 6 WHEN 0 THEN 'CA' WHEN 1 THEN ' us' WHEN 2 THEN 'JP' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'US' END AS country_code,
               CASE p_partkey % 11 WHEN 0 THEN 'chequing' WHEN 1 THEN 'Savings' WHEN 2 THEN 'gic' WHEN 3 THEN 'credit-card' WHEN 4 THEN 'mortgage' WHEN 5 THEN 'personal-loan' WHEN 6 THEN 'line-of-credit' WHEN 7 THEN '' WHEN 8 THEN 'new-type' WHEN 9 THEN 'savings' ELSE 'gic' END AS product_type,
               concat('{{"monthly_fee": ', CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '"$5"' WHEN 2 THEN '4.5' ELSE 'null' END, CASE p_partkey % 3 WHEN 0 THEN ', "public_display_rate": 2.5' WHEN 1 THEN ', "standard_rate": "as agreed", "base_12_month_rate": "3.1%"' ELSE '' END,
                      CASE p_partkey % 5 WHEN 0 THEN ', "promotional_rate": 5' WHEN 1 THEN ', "minimum_balance": 100' WHEN 2 THEN ', "minimum_deposit": "500", "fee_waiver_condition": " "' ELSE ', "fee_waiver_condition": "Keep $4,000"' END,
                      CASE p_partkey % 7 WHEN 0 THEN ', "redeemable_flag": "true"' WHEN 1 THEN ', "redeemable_flag": false, "unlimited_transactions_flag": false' WHEN 2 THEN ', "non_redeemable_flag": true, "unlimited_transactions_flag": true' ELSE ', "included_transactions": 12' END,
                      CASE p_partkey % 8 WHEN 0 THEN ', "term_rate_table": [{{"rate": "4%", "term_label": "1 year"}}]' WHEN 1 THEN ', "term_rate_table": [{{"rate": 4}}], "term_length_text": "1 year"' WHEN 2 THEN ', "interest_rate_summary": "Interest rate of 4.5%", "rate_type": "fixed", "term_length_text": "5 years"'
                        WHEN 3 THEN ', "interest_rate_summary": "Ask us", "interest_rate": 7, "loan_amount_text": "up to $5", "credit_limit_text": "$9"' ELSE ', "annual_fee": "$120", "purchase_interest_rate": 19.99, "secured_flag": true, "early_withdrawal_penalty": "90 days"' END, '}}') AS payload,
               CASE p_partkey % 2 WHEN 0 THEN 'standard_rate,monthly_fee,notes' ELSE 'standard_rate,notes' END AS expected
        FROM {part}""",
    "judged": """
        SELECT concat('N', CAST(p_partkey AS STRING)) AS candidate_id, CASE p_partkey % 13 WHEN 0 THEN 'US' WHEN 1 THEN 'JP' ELSE 'CA' END AS country_code, concat('B', CAST(p_partkey % 10 AS STRING)) AS bank_code, 'deposit' AS product_family,
               CASE p_partkey % 4 WHEN 0 THEN 'savings' WHEN 1 THEN 'chequing' WHEN 2 THEN 'gic' ELSE 'savings' END AS product_type, CASE p_partkey % 19 WHEN 3 THEN 'No-Fee Banking' ELSE p_name END AS product_name,
               CASE p_partkey % 11 WHEN 0 THEN 'fixed' WHEN 1 THEN NULL ELSE 'other' END AS subtype_code, CASE p_partkey % 17 WHEN 0 THEN '' ELSE 'CAD' END AS currency, CASE p_partkey % 23 WHEN 0 THEN 'English' ELSE 'en-CA' END AS source_language,
               CASE p_partkey % 29 WHEN 0 THEN 'partial read' ELSE 'read' END AS note, CASE p_partkey % 31 WHEN 0 THEN 'hub_page_not_detail' ELSE 'detail' END AS reason, CAST(p_size % 13 AS STRING) AS standard_rate,
               CASE p_partkey % 37 WHEN 0 THEN '2' ELSE CAST(p_size % 13 AS STRING) END AS linked_rate, CASE p_partkey % 41 WHEN 0 THEN 'Rates as of 2020-01-02' ELSE 'Rates as of 2026-01-02' END AS excerpt,
               concat('{{"status": "active", "last_verified_at": "', CASE p_partkey % 43 WHEN 0 THEN 'soon' ELSE '2026-04-01T00:00:00Z' END, '", "standard_rate": ', CAST(p_size % 13 AS STRING), ', "monthly_fee": ', CASE p_partkey % 7 WHEN 0 THEN '600' WHEN 1 THEN '"free"' ELSE '0' END,
                      ', "minimum_balance": ', CASE p_partkey % 9 WHEN 0 THEN '-1' WHEN 1 THEN 'null' ELSE '5' END, ', "minimum_deposit": 1, "redeemable_flag": true, "included_transactions": 12, "term_length_days": ', CASE p_partkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '1.5' ELSE '365' END,
                      CASE p_partkey % 5 WHEN 0 THEN ', "public_display_rate": 4' WHEN 1 THEN ', "non_redeemable_flag": true' WHEN 2 THEN ', "unlimited_transactions_flag": true' ELSE '' END, '}}') AS payload
        FROM {part}""",
    "source_snapshot": """
        SELECT concat('N', CAST(o_orderkey AS STRING)) AS snapshot_id, concat('D', CAST(o_custkey % 300 AS STRING)) AS source_document_id, o_orderdate AS fetched_at FROM {orders}""",
    "parsed_document": """
        SELECT concat('A', CAST(o_orderkey AS STRING)) AS parsed_document_id, concat('N', CAST(o_orderkey AS STRING)) AS snapshot_id FROM {orders} WHERE o_orderkey % 13 <> 5""",
    "evidence_chunk": """
        SELECT DISTINCT concat('K', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS chunk_id, concat('A', CAST(l_orderkey AS STRING)) AS parsed_document_id FROM {lineitem}""",
    "field_evidence_link": """
        SELECT concat('K', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS chunk_id, concat('F', CAST(l_partkey AS STRING)) AS field_id FROM {lineitem} WHERE l_partkey % 50 = 3""",
    "ingestion_run": """
        SELECT concat('R', CAST(o_orderkey AS STRING)) AS run_id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'started' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS run_state, o_orderdate AS started_at,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate + INTERVAL '2' HOUR END AS completed_at, concat('{{"pipeline_stage": "parse", "bank_code": "B', CAST(o_custkey % 10 AS STRING), '"', CASE o_orderkey % 3 WHEN 0 THEN ', "notes": ["long", "ones"]' ELSE '' END, '}}') AS run_metadata
        FROM {orders}""",
    "run_source_item": """
        SELECT concat('R', CAST(o_orderkey AS STRING)) AS run_id, concat('N', CAST(o_orderkey * 7 % 15000 AS STRING)) AS selected_snapshot_id FROM {orders}""",
    "model_execution": """
        SELECT concat('M', CAST(event_id AS STRING)) AS execution_id, concat('R', CAST(event_id * 3 AS STRING)) AS run_id, CASE WHEN event_id % 17 = 0 THEN 'started' ELSE 'completed' END AS execution_status,
               CASE event_type WHEN 'view' THEN 'ai_verification' ELSE event_type END AS stage_name, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('T', CAST(user_id AS STRING)) END AS review_task_id, ts AS started_at FROM {events}""",
    "candidate": """
        SELECT concat('N', CAST(o_orderkey AS STRING)) AS candidate_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('M', CAST(o_orderkey % 4000 AS STRING)) END AS execution_id FROM {orders}""",
    "refresh_request": """
        SELECT concat('Q', CAST(event_id AS STRING)) AS request_id, CASE event_type WHEN 'view' THEN 'waiting' WHEN 'click' THEN 'failed' ELSE 'completed' END AS request_status, ts AS requested_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL '3' HOUR END AS completed_at FROM {events}""",
    "login_attempt": """
        SELECT event_id AS attempt_id, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '10.0.0.1' ELSE concat('10.0.', CAST(user_id % 7 AS STRING), '.', CAST(user_id AS STRING)) END AS ip_address,
               CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'failed' WHEN 'error' THEN 'locked_out' ELSE 'rate_limited' END AS attempt_outcome, ts AS attempted_at FROM {events}""",
    "admin_session": """
        SELECT concat('S', CAST(event_id AS STRING)) AS session_id, CASE WHEN event_id % 3 = 0 THEN ts ELSE NULL END AS revoked_at, ts + INTERVAL '12' HOUR AS absolute_expires_at FROM {events}""",
    "named": """
        SELECT concat('P', CAST(p_partkey AS STRING)) AS product_id, concat('B', CAST(p_partkey % 10 AS STRING)) AS bank_code,
               CASE p_partkey % 9 WHEN 8 THEN 'Savings Account' ELSE concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' Account' WHEN 1 THEN ' Plus Account' WHEN 2 THEN '' ELSE ' Plus Savings Account' END) END AS product_name
        FROM {part}""",
    "excerpt": """
        SELECT concat('X', CAST(a.p_partkey AS STRING)) AS evidence_id, concat('B', CAST(a.p_partkey % 10 AS STRING)) AS bank_code, concat('P', CAST(a.p_partkey AS STRING)) AS product_id,
               CASE a.p_partkey % 8 WHEN 0 THEN concat('The ', a.p_name, ' Account has a monthly fee of $5.') WHEN 1 THEN concat('Monthly fee of the ', b.p_name, ': $9') WHEN 2 THEN concat(b.p_name, ' plus account, and ', a.p_name, '. Fees apply')
                 WHEN 3 THEN concat(a.p_name, ' Plus Savings Account: 4%') WHEN 4 THEN 'Savings accounts and credit cards of this bank' WHEN 5 THEN concat(b.p_name, '-PLUS! ', b.p_name, ' Account') WHEN 6 THEN NULL ELSE concat('(', a.p_name, ') plus account; plus ', b.p_name) END AS text
        FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 10""",
    "page_chunk": samples.page_chunks("p_partkey", "{part}"),
    "candidate_field": samples.candidate_fields("p_partkey", "{part}"),
}

NEEDS = {"product": ("bank",)}
#: Relations whose rows cost much to work on and whose table is a file too small for a task of each core, by that table.
DEALT = {"offer": "part", "judged": "part", "candidate_field": "part", "captured": "part", "profiled": "part", "page_chunk": "part"}
#: Rows of such a table in one task at most, and at least where there are tasks enough.
MOST, LEAST = 20_000, 500
#: The same of rows that are sorted by key, whose tasks hold them all.
SORTED = 200_000, 20_000


def tasks(df: DataFrame, most: int, least: int) -> int:
    """Into how many tasks a table goes, by its rows: at most ``most`` in one, and all cores where they get ``least`` each."""
    n = df.count()  # from the footers of a file
    return max(1, -(-n // most), min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // least)))


def dealt(df: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """``df`` dealt to all cores, and to more tasks the more rows it has; Parquet splits no row group, however much work a row is."""
    n = tasks(df, most, least)
    return df.repartition(n) if n > 1 else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table by its Parquet, or a relation of ``VIEWS``."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    names = [n for n in BASE + tuple(VIEWS) if f"{{{n}}}" in VIEWS[name]]
    own = {n: read(spark, sf_dir, n) for n in names}
    if name == "version":
        own["lineitem"] = own["lineitem"].repartition(tasks(own["lineitem"], *SORTED), "l_partkey")
    if name in DEALT:
        own[DEALT[name]] = dealt(own[DEALT[name]])
    return spark.sql(VIEWS[name], **own)


def sql(text: str, *views: str) -> str:
    """``text`` after the relations that it reads, as common table expressions in DuckDB's SQL."""
    order = list(dict.fromkeys(v for name in views for v in (*NEEDS.get(name, ()), name)))
    names = {n: n for n in (*BASE, *VIEWS)}
    own = ",\n".join(f"{v} AS ({VIEWS[v].format(**names).replace('AS STRING', 'AS VARCHAR')})" for v in order)
    return f"WITH {own}\n{text}" if own and not text.lstrip().upper().startswith("WITH ") else f"WITH {own},\n{text.lstrip()[5:]}" if own else text
