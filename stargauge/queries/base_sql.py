"""The rating entities and feature sets as plain SQL views over the warehouse tables.

They restate the views and operators independently, in the order in which they build on each
other. Names start with ``v_`` so that a statement's mention of one is unmistakable.
"""

BASE = {
    # ---- raw entities
    "v_reviews": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                         CAST(round(l_extendedprice * 100) AS BIGINT)) AS review_id,
               o_custkey AS user_id, l_partkey AS business_id,
               CAST((CAST(l_quantity AS INT) - 1) % 5 + 1 AS BIGINT) AS stars,
               CAST(l_linenumber AS BIGINT) AS useful, o_orderdate AS written
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_train_reviews": """
        SELECT review_id, user_id, business_id, stars AS rev_stars, useful, written
        FROM v_reviews WHERE written < TIMESTAMP '2000-01-01'""",
    "v_test_reviews": """
        SELECT review_id, user_id, business_id
        FROM v_reviews WHERE written >= TIMESTAMP '2000-01-01'""",
    "v_raw_business": """
        SELECT p_partkey AS business_id,
               CASE WHEN p_partkey % 23 = 0 THEN NULL
                    WHEN p_partkey % 40 = 20 THEN p_name
                    WHEN p_partkey % 4 = 0 THEN concat('Solo ', p_partkey)
                    WHEN p_partkey % 4 IN (1, 2)
                        THEN concat('Pair ', p_partkey % 4, ' ', p_partkey // 8)
                    ELSE p_name END AS name,
               CASE WHEN p_partkey % 17 = 0 THEN CAST([] AS VARCHAR[])
                    WHEN p_partkey % 3 = 0 THEN [p_type, p_brand, split_part(p_name, ' ', 2)]
                    ELSE [p_type, split_part(p_name, ' ', 2)] END AS categories,
               concat('St ', p_partkey, ', Phoenix, AZ',
                      CASE WHEN p_partkey % 13 = 0 THEN ''
                           ELSE concat(' ', 85000 + p_partkey % 50) END) AS full_address,
               CAST(-112.0 AS DOUBLE) + (p_partkey % 1000) / CAST(777.0 AS DOUBLE) AS longitude,
               CAST(33.0 AS DOUBLE) + (p_partkey % 1000) / CAST(555.0 AS DOUBLE) AS latitude,
               p_partkey % 9 <> 0 AS is_open,
               CAST(p_size AS BIGINT) AS review_count,
               CASE WHEN p_partkey % 10 <> 0
                    THEN 1 + (p_size % 9) * CAST(0.5 AS DOUBLE) END AS stars,
               p_partkey % 10 <> 0 AS is_train
        FROM part""",
    "v_raw_user": """
        SELECT c_custkey AS user_id, c_name AS name,
               CAST(c_custkey % 40 AS BIGINT)
                   + CASE WHEN c_custkey % 7 <> 0 THEN 1 ELSE 0 END AS review_count,
               CASE WHEN c_custkey % 7 <> 0
                    THEN CAST(0.5 AS DOUBLE) + (c_custkey % 46) / CAST(10.0 AS DOUBLE) END
                   AS average_stars,
               c_custkey % 7 <> 0 AS is_train
        FROM customer WHERE c_custkey % 11 <> 0""",
    "v_checkin": """
        SELECT user_id AS business_id, count(*) AS total
        FROM events GROUP BY user_id""",
    "v_lookup": """
        SELECT user_id, business_id,
               min(CAST('0x' || substr(md5(review_id), 1, 8) AS BIGINT)) AS RecommendationId
        FROM v_test_reviews GROUP BY ALL""",
    "v_lexicon": """
        SELECT DISTINCT term, CAST(length(term) % 11 - 5 AS INT) AS score
        FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM benchmark)""",
    # ---- cleaned entities
    "v_business": """
        SELECT business_id, name AS bus_name, categories AS bus_categories,
               is_open AS bus_open, review_count AS bus_review_count, stars AS bus_stars,
               CASE WHEN contains(right(full_address, 5), 'AZ') THEN 'Missing'
                    ELSE right(full_address, 5) END AS bus_zip_code, is_train
        FROM v_raw_business""",
    "v_user": """
        SELECT user_id, name AS user_name,
               CASE WHEN NOT is_train AND review_count < 1
                    THEN (SELECT avg(review_count) FROM v_raw_user WHERE is_train)
                    ELSE CAST(review_count AS DOUBLE) END AS user_review_count,
               CASE WHEN average_stars < 1
                    THEN (SELECT avg(average_stars) FROM v_raw_user WHERE is_train)
                    ELSE average_stars END AS user_average_stars, is_train
        FROM v_raw_user""",
    "v_train_business": "SELECT * EXCLUDE (is_train) FROM v_business WHERE is_train",
    "v_test_business": "SELECT * EXCLUDE (is_train) FROM v_business WHERE NOT is_train",
    "v_all_business": "SELECT * EXCLUDE (is_train) FROM v_business",
    "v_train_user": "SELECT * EXCLUDE (is_train) FROM v_user WHERE is_train",
    "v_test_user": "SELECT * EXCLUDE (is_train) FROM v_user WHERE NOT is_train",
    "v_all_user": "SELECT * EXCLUDE (is_train) FROM v_user",
    "v_global": "SELECT avg(rev_stars) AS mean FROM v_train_reviews",
    # ---- joined sets
    "v_train_all": """
        SELECT * FROM v_train_reviews JOIN v_train_business USING (business_id)
        JOIN v_train_user USING (user_id) LEFT JOIN v_checkin USING (business_id)""",
    "v_test_all": """
        SELECT * FROM v_test_reviews JOIN v_train_business USING (business_id)
        JOIN v_train_user USING (user_id) LEFT JOIN v_checkin USING (business_id)""",
    "v_master": """
        SELECT * FROM v_test_reviews LEFT JOIN v_all_business USING (business_id)
        LEFT JOIN v_all_user USING (user_id) LEFT JOIN v_checkin USING (business_id)""",
    "v_missing_users": """
        SELECT r.* FROM v_train_reviews r
        JOIN (SELECT DISTINCT t.user_id FROM v_test_reviews t
              LEFT JOIN v_train_user u USING (user_id)
              WHERE u.user_average_stars IS NULL) USING (user_id)""",
    # ---- dimensions
    "v_review_categories": """
        SELECT category, count(*) AS cat_count, avg(rev_stars) AS cat_avg_stars
        FROM (SELECT unnest(bus_categories) AS category, rev_stars FROM v_train_all)
        GROUP BY category ORDER BY cat_count DESC, category LIMIT 421""",
    "v_business_categories": """
        SELECT category, CAST(count(*) AS DOUBLE) AS cat_tot_count,
               avg(bus_stars) AS cat_avg_stars
        FROM (SELECT unnest(bus_categories) AS category, bus_stars FROM v_all_business
              WHERE bus_review_count > 3 AND bus_stars > 0)
        GROUP BY category HAVING count(*) > 2""",
    "v_grouped_categories": """
        SELECT bus_categories, count(*) AS cat_counts,
               CASE WHEN len(bus_categories) > 0 THEN sum(bus_stars) ELSE 0.0 END / count(*)
                   AS cat_avg_stars
        FROM v_all_business WHERE bus_review_count > 4 AND bus_stars > 0
        GROUP BY bus_categories""",
    "v_names": """
        SELECT bus_name, count(*) AS bus_name_counts, sum(bus_stars) AS total_stars,
               sum(bus_stars) / count(*) AS bus_name_avg
        FROM v_train_business WHERE bus_name IS NOT NULL GROUP BY bus_name""",
    "v_grouped_businesses": """
        SELECT b.business_id, g.cat_counts AS grp_cat_counts,
               g.cat_avg_stars AS grp_cat_avg_stars
        FROM v_all_business b LEFT JOIN v_grouped_categories g USING (bus_categories)""",
    # ---- features
    "v_scores": """
        SELECT business_id, avg(r.cat_avg_stars) AS calc_cat_avg,
               avg(s.cat_avg_stars) AS calc_cat_avg_bus_avg
        FROM (SELECT business_id, unnest(bus_categories) AS category FROM v_all_business)
        LEFT JOIN v_review_categories r USING (category)
        LEFT JOIN v_business_categories s USING (category)
        GROUP BY business_id""",
    "v_user_averages": """
        SELECT user_id, CAST(count(*) AS DOUBLE) AS calc_user_rev_count,
               avg(rev_stars) AS calc_user_avg_stars
        FROM v_missing_users GROUP BY user_id""",
    "v_train_set": """
        SELECT t.* EXCLUDE (total), coalesce(total, 0) AS calc_total_checkins,
               coalesce(calc_cat_avg, 3.766723066) AS calc_cat_avg, calc_cat_avg_bus_avg,
               n.* EXCLUDE (bus_name), g.* EXCLUDE (business_id)
        FROM v_train_all t LEFT JOIN v_scores s USING (business_id)
        LEFT JOIN (SELECT * FROM v_names WHERE bus_name_counts > 1) n USING (bus_name)
        LEFT JOIN v_grouped_businesses g USING (business_id)""",
    "v_test_set": """
        SELECT t.* EXCLUDE (total), coalesce(total, 0) AS calc_total_checkins,
               coalesce(calc_cat_avg, 3.766723066) AS calc_cat_avg
        FROM v_test_all t LEFT JOIN v_scores s USING (business_id)""",
    "v_master_set": """
        SELECT t.* EXCLUDE (total), coalesce(total, 0) AS calc_total_checkins,
               calc_cat_avg, calc_cat_avg_bus_avg,
               n.* EXCLUDE (bus_name), g.* EXCLUDE (business_id), a.* EXCLUDE (user_id)
        FROM v_master t LEFT JOIN v_scores s USING (business_id)
        LEFT JOIN v_names n USING (bus_name)
        LEFT JOIN v_grouped_businesses g USING (business_id)
        LEFT JOIN v_user_averages a USING (user_id)""",
}


# The white space at which review text is cut into words, for the SQL engine's matcher.
SPACE = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def held_out(fold: str, share: float, key: str = "review_id") -> str:
    """Hold-out rule of a fold; the hash is the same on both engines."""
    digest = f"substr(md5(concat_ws('|', {fold}, {key})), 1, 8)"
    return f"CAST('0x' || {digest} AS BIGINT) < {int(share * 2**32)}"


def least_squares(rows: str, features: list[str], label: str, group: str) -> str:
    """Predictions of one least-squares fit per group, by orthogonalising the features.

    ``rows`` has the features, the label, the group and ``fit``, true for rows to fit on.
    The result has all columns of ``rows`` and ``predicted``.
    """
    steps = [f"ols_0 AS MATERIALIZED (SELECT * FROM ({rows}))"]
    for i, name in enumerate(features, 1):
        previous = f"ols_{i - 1}"
        slopes = "".join(
            f", covar_pop({name}, q_{j}) / var_pop(q_{j}) AS s_{j}" for j in range(1, i)
        )
        minus = "".join(f" - k.s_{j} * p.q_{j}" for j in range(1, i))
        steps.append(
            f"ols_{i} AS MATERIALIZED (SELECT p.*, p.{name} - k.m{minus} AS q_{i} "
            f"FROM {previous} p JOIN (SELECT {group}, avg({name}) AS m{slopes} "
            f"FROM {previous} WHERE fit GROUP BY {group}) k USING ({group}))"
        )
    last = f"ols_{len(features)}"
    numbers = range(1, len(features) + 1)
    slopes = "".join(f", covar_pop({label}, q_{j}) / var_pop(q_{j}) AS s_{j}" for j in numbers)
    plus = "".join(f" + k.s_{j} * p.q_{j}" for j in numbers)
    steps.append(
        f"fitted AS (SELECT p.*, k.m{plus} AS predicted FROM {last} p JOIN (SELECT {group}, "
        f"avg({label}) AS m{slopes} FROM {last} WHERE fit GROUP BY {group}) k USING ({group}))"
    )
    return "WITH " + ",\n".join(steps)
