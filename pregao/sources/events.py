"""A trade ledger derived from a table of click-stream events.

The sample data holds no trade export. Each event becomes one trade, with
integer arithmetic only, so any SQL engine gives the same rows; every column the
rules look at has missing values or zeros in some. Lookups replace
long CASE chains: Catalyst copies a column's expression into every filter that
is pushed below it, and the copies have to stay small enough to be compiled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# The tickers dealt out in turn, and the seconds on the edges of the windows.
TICKERS = "WINJ23 WINM23 WDOJ23 WDOK23 DOLK23 INDJ23 CCMK23 CCMU23 PETR4 VALE3 ITUB4 BBDC4 MGLU3 ABEV3 B3SA3 WEGE3"
EDGE_SECONDS = "61200, 32700, 61201, 36000, 43200, 54000, 32400, 32701"

LEDGER_SQL = f"""
SELECT
  event_id,
  IF(event_id % 79 = 7, NULL,
     DATE_ADD(CAST(ts AS DATE),
              CAST(event_id % 4 * 30 + IF(event_id % 7 = 0, 366, 0) AS INT))) AS data,
  IF(event_id % 89 = 3, NULL, CONCAT('OP', LPAD(user_id % 12, 2, '0'))) AS nome,
  IF(event_id % 83 = 5, NULL,
     GET(SPLIT('{TICKERS}', ' '), CAST(event_id % 16 AS INT))) AS codigo,
  IF(event_id % 71 = 4, NULL, IF(event_type IN ('click', 'purchase'), 'Compra', 'Venda')) AS lado,
  IF(event_id % 67 = 6, 0, (1 + user_id % 5) * IF(event_id % 16 < 8, 1, 100)) AS quantidade,
  IF(event_id % 61 = 8, 0D, 10 + event_id * 37 % 9000 / 100D) AS preco,
  IF(event_id % 13 = 0, 0D, value) AS bruto,
  CASE WHEN event_id % 101 = 5 THEN NULL
       WHEN event_id % 11 = 0 THEN 0D
       WHEN event_id % 16 = 15 OR (event_id * 7919 + user_id * 31) % 100 < 55 THEN value
       ELSE -value END AS liquido,
  IF(event_id % 103 = 0, 32000, (event_id * 31 + user_id * 17) % 33000) AS duracao,
  IF(event_id % 73 = 2, NULL,
     SUBSTRING(CAST(TIMESTAMP_NTZ'2000-01-01' + seconds * INTERVAL '1' SECOND AS STRING), 12, 8)) AS hora
FROM (
  SELECT *,
    CASE WHEN event_id % 97 = 0 THEN GET(ARRAY({EDGE_SECONDS}), CAST(event_id % 8 AS INT))
         WHEN event_id % 5 = 0 THEN 32400 + event_id % 301
         ELSE 32400 + event_id * 7919 % 34200 END AS seconds
  FROM {{events}}
)
"""


def ledger_from_events(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(LEDGER_SQL, events=events)
