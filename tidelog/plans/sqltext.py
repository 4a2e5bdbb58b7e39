"""Queries written as SQL over temporary views; Catalyst plans them as it does the DataFrame forms."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _sql(df: DataFrame, text: str) -> DataFrame:
    return df.sparkSession.sql(text, log=df)


def mapped_view(raw: DataFrame) -> DataFrame:
    """The raw log with date, hour as text, and behaviour names, after all columns that it has."""
    return _sql(
        raw,
        """SELECT *, substr(time, 1, 10) AS behavior_date,
                  substr(time, 12, 2) AS behavior_hour,
                  CASE behavior_type WHEN '1' THEN 'pv' WHEN '2' THEN 'fav' WHEN '3' THEN 'cart' WHEN '4' THEN 'buy'
                       ELSE 'unknown' END AS behavior_name
           FROM {log}""",
    )


def behavior_distribution(clean: DataFrame) -> DataFrame:
    return _sql(
        clean,
        """SELECT behavior_name, count(*) AS behavior_count,
                  round(CAST(count(*) AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS percentage
           FROM {log} WHERE behavior_name IN ('pv', 'fav', 'cart', 'buy') GROUP BY behavior_name""",
    )


def behavior_statistics(clean: DataFrame) -> DataFrame:
    """With the repeat buyers as an IN subquery, as a semi-join."""
    return _sql(
        clean,
        """SELECT count(DISTINCT user_id) AS total_users,
                  CAST(sum(CASE WHEN behavior_type = 4 THEN 1 ELSE 0 END) AS BIGINT) AS total_purchases,
                  count(DISTINCT CASE WHEN behavior_type = 4 THEN user_id END) AS buyers,
                  count(DISTINCT user_id) - count(DISTINCT CASE WHEN behavior_type = 4 THEN user_id END) AS non_buyers,
                  count(DISTINCT CASE WHEN user_id IN
                    (SELECT user_id FROM {log} WHERE behavior_type = 4 GROUP BY user_id HAVING count(*) >= 2) THEN user_id END) AS repeat_buyers
           FROM {log}""",
    )


def descriptive_funnel(clean: DataFrame) -> DataFrame:
    return _sql(
        clean,
        """SELECT stage, n AS behavior_count, round(try_divide(CAST(n AS DOUBLE) * CAST(100 AS DOUBLE), CAST(pv AS DOUBLE)), 2) AS pct_of_pv
           FROM (SELECT count_if(behavior_name = 'pv') AS pv, count_if(behavior_name = 'fav') AS fav,
                        count_if(behavior_name = 'cart') AS cart, count_if(behavior_name = 'buy') AS buy FROM {log})
           LATERAL VIEW stack(4, 'pv', pv, 'fav', fav, 'cart', cart, 'buy', buy) s AS stage, n""",
    )
