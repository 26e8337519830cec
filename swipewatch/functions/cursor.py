"""Page cursors: base64url text, without padding, of an instant and an id."""

from __future__ import annotations

import base64
import re
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from swipewatch.functions.columns import iso_instant

_INSTANT = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?)(?:\.(\d{1,9}))?Z")


def encode_cursor(us: Column, row_id: Column) -> Column:
    # base64() breaks long text into lines; translate drops the breaks and the padding.
    return F.translate(F.base64(F.concat(iso_instant(us), F.lit("|"), row_id).cast("binary")), "+/=\r\n", "-_")


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    """(instant, id) of one cursor. Anything malformed raises the same plain ``ValueError``."""
    try:
        if not re.fullmatch(r"[A-Za-z0-9_-]+={0,2}", cursor):
            raise ValueError("alphabet")
        bare = cursor.rstrip("=")
        text = base64.urlsafe_b64decode(bare + "=" * (-len(bare) % 4)).decode("utf-8")
        instant, _, row_id = text.partition("|")
        seconds, fraction = _INSTANT.fullmatch(instant).groups()
        moment = datetime.fromisoformat(seconds).replace(tzinfo=timezone.utc)
        moment += timedelta(microseconds=int((fraction or "0").ljust(9, "0")) // 1000)
        return moment, str(uuid.UUID(row_id))
    except Exception as problem:
        raise ValueError(f"Invalid or malformed cursor: {cursor}") from problem


def cursor_text(moment: datetime, row_id: str) -> str:
    """One cursor on the driver, the counterpart of :func:`decode_cursor`."""
    moment = moment.astimezone(timezone.utc)
    digits = f"{moment.microsecond:06d}"
    fraction = "" if digits == "000000" else "." + (digits[:3] if digits.endswith("000") else digits)
    text = f"{moment:%Y-%m-%dT%H:%M:%S}{fraction}Z|{row_id}"
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
