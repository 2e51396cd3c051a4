"""Small hand-made entities: rows are dicts, columns left out are null."""

from __future__ import annotations

import datetime as dt

from crmkiln import schemas

NOON = dt.datetime(2023, 4, 1, 13, 0, 0)


def entity(spark, name, rows):
    fields = schemas.RAW[name].fields
    unknown = {key for row in rows for key in row} - {field.name for field in fields}
    assert not unknown, unknown
    data = [tuple(row.get(field.name) for field in fields) for row in rows]
    return spark.createDataFrame(data, schemas.RAW[name])


def deal(deal_id=1, **values):
    row = {
        "deal_id": deal_id, "amount": 100.0, "stage": "Proposal", "pipeline": "SMB",
        "probability": 50.0, "days_in_pipeline": 10, "created_at": NOON,
        "industry": "Finance", "region": "Europe",
    }
    return row | values


def session(session_id=1, **values):
    row = {
        "session_id": session_id, "page_url": "/", "country": "US", "device_type": "Mobile",
        "session_duration_sec": 40, "page_views": 3, "bounce": 0, "conversion": 0,
        "timestamp": NOON,
    }
    return row | values


def ticket(ticket_id=1, **values):
    row = {
        "ticket_id": ticket_id, "category": "Billing", "priority": "Low",
        "resolution_hours": 5.0, "satisfaction_score": 4, "created_at": NOON,
    }
    return row | values


def column(df, name, order):
    return [row[name] for row in df.orderBy(order).collect()]
