"""Small ledgers for the unit tests."""

from __future__ import annotations

import datetime as dt

SCHEMA = (
    "data date, hora string, nome string, codigo string, lado string, quantidade bigint, "
    "preco double, bruto double, liquido double, duracao bigint"
)
DEFAULT = {
    "data": dt.date(2023, 4, 3),
    "hora": "10:30:00",
    "nome": "OP01",
    "codigo": "PETR4",
    "lado": "Compra",
    "quantidade": 100,
    "preco": 10.0,
    "bruto": 1.0,
    "liquido": 1.0,
    "duracao": 60,
}


def ledger(spark, *trades: dict):
    rows = [tuple({**DEFAULT, **trade}.values()) for trade in trades]
    return spark.createDataFrame(rows, SCHEMA)


def as_dicts(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]
