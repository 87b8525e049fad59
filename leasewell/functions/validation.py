"""Validation and derived values as column expressions; Python only where Spark has no equal function."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leasewell.limits import DEFAULT

#: Characters that Unicode counts as white space (fixed values), for trimming.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def queue_name_valid(name: str) -> Column:
    """1 to 128 bytes of letters, digits, dot, underscore and hyphen."""
    return _sure(F.col(name).rlike(r"\A[A-Za-z0-9._-]{1,128}\z"))


def receipt_text(message_id: str, epoch: str, secret: str) -> Column:
    """A receipt: id, lease epoch and 32 hex digits."""
    return F.concat_ws(".", F.col(message_id), F.col(epoch).cast("string"), F.col(secret))


def receipt_valid(receipt: str, message_id: str, epoch: str) -> Column:
    """Whether a receipt is of this message and epoch."""
    head = F.concat(F.col(message_id), F.lit("."), F.col(epoch).cast("string"), F.lit("."))
    return _sure(F.startswith(F.col(receipt), head) & (F.length(receipt) == F.length(head) + 32) & F.substring(F.col(receipt), -32, 32).rlike(r"\A[0-9a-f]{32}\z"))


def fingerprint_valid(fingerprint: str) -> Column:
    """64 lower-case hex digits."""
    return _sure(F.col(fingerprint).rlike(r"\A[0-9a-f]{64}\z"))


def key_valid(key: str) -> Column:
    """An idempotency key: 1 to 256 visible ASCII characters."""
    return _sure(F.col(key).rlike(rf"\A[!-~]{{1,{DEFAULT.key_bytes}}}\z"))


def reason_trimmed(reason: str, most: int = DEFAULT.reason_bytes) -> Column:
    """A reason without outer white space, cut to so many bytes between characters.

    A character has at most four bytes, so the cut is at the last of four places at which no continuation byte is.
    """
    text = F.trim(F.col(reason), F.lit(WHITE_SPACE))
    data = F.encode(text, "UTF-8")
    follows = lambda at: F.hex(F.substring(data, at, 1)).rlike("^[89AB]")
    end = F.when(~follows(most + 1), most).when(~follows(most), most - 1).when(~follows(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), end), "UTF-8"))


def cursor_scope(queue: str, state: Column, dead_only: Column) -> Column:
    """What a page cursor belongs to: 32 hex digits of a digest of queue, state filter and kind of list."""
    zero = F.unhex(F.lit("00"))
    kind = F.when(dead_only, F.unhex(F.lit("01"))).otherwise(zero)
    text = F.concat(F.encode(F.col(queue), "UTF-8"), zero, F.encode(F.coalesce(state, F.lit("")), "UTF-8"), zero, kind)
    return F.substring(F.sha2(text, 256), 1, 32)


def cursor_text(scope: Column, lsn: Column, high_water: Column, sequence: Column, generation: Column, second: Column, nano: Column) -> Column:
    """A cursor of 150 characters; seconds are shifted by 2**63 so that they sort as digits."""
    shifted = (second.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)")
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws(".", F.lit("v3"), scope, digits(lsn, 20), digits(high_water, 20), digits(sequence, 20), digits(generation, 20), digits(shifted, 20), digits(nano, 9))


def cursor_fields(cursor: str) -> Column:
    """A struct of a cursor's fields; null if it is malformed."""
    part = lambda k: F.try_element_at(F.split(F.col(cursor), r"\."), F.lit(k + 1))
    number = lambda k: part(k).try_cast("decimal(20,0)")
    shape = F.col(cursor).rlike(r"\Av3\.[0-9a-fA-F]{32}(\.[0-9]{20}){5}\.[0-9]{9}\z")
    top = F.lit("18446744073709551615").cast("decimal(20,0)")
    fits = (number(2) <= top) & (number(3) <= top) & (number(4) <= number(3)) & (number(5) <= top) & (number(6) <= top)
    second = (number(6) - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint")
    fields = F.struct(part(1).alias("scope"), number(2).alias("snapshot_lsn"), number(3).alias("high_water"), number(4).alias("sequence"), number(5).alias("generation"), second.alias("second"), part(7).try_cast("bigint").alias("nano"))
    return F.when(_sure(shape & fits), fields)


def duration_us(milliseconds: str) -> Column:
    """Milliseconds as microseconds; null for a negative number or one whose nanoseconds overflow 64 bits."""
    ms = F.col(milliseconds)
    return F.when((ms >= 0) & (ms <= (2**63 - 1) // 1_000_000), ms * 1000)


def after(at: Column, us: Column) -> Column:
    """A time plus microseconds."""
    return at + F.make_dt_interval(secs=(us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


EPOCH = "1970-01-01 00:00:00"


def epoch_second(at: Column) -> Column:
    """Whole seconds since 1970 of a time without zone."""
    return F.datediff(F.to_date(at), F.to_date(F.lit(EPOCH))).cast("bigint") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60 + F.second(at)


def nanosecond(at: Column) -> Column:
    """Nanoseconds of a time within its second."""
    part = F.date_part(F.lit("SECOND"), at)
    return ((part - F.floor(part)) * 1_000_000_000).cast("bigint")


def at_epoch(second: Column, nano: Column) -> Column:
    """The time without zone so many seconds and nanoseconds after 1970, in microseconds."""
    return after(F.lit(EPOCH).cast("timestamp_ntz"), second * 1_000_000 + F.floor(nano / 1_000))


def available_at(now: Column, delay_us: Column, requested: Column, most_delay_us: int = DEFAULT.delay) -> Column:
    """When a message becomes available: after its delay, or at the requested time if that is later; null if the
    delay is out of bounds or the time is beyond the longest delay."""
    at = F.greatest(after(now, delay_us), F.coalesce(requested, now))
    return F.when((delay_us >= 0) & (delay_us <= most_delay_us) & (at <= after(now, F.lit(most_delay_us))), at)


def added(at: Column, us: Column) -> Column:
    """A time plus a duration; null if the duration is negative or the year leaves 0 to 9999."""
    out = after(at, us)
    return F.when((us >= 0) & (F.year(out) <= 9999), out)


def schedule_exclusive(delay: str, at: str) -> Column:
    """A request may give a delay or a time, not both."""
    return ~(F.col(delay).isNotNull() & F.col(at).isNotNull())


def utf8_valid(data: str) -> Column:
    """Whether bytes are valid UTF-8."""
    return _sure(F.is_valid_utf8(F.col(data)))


def _unique(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("duplicate key")
    return found


def _refused(name: str):
    raise ValueError(name)


def strict_object(text: str, fields: frozenset[str] | None = None) -> bool:
    """Whether a text is one strict JSON object."""
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_refused)
        json.dumps(value, ensure_ascii=False).encode()  # a lone surrogate cannot be encoded
    except (ValueError, TypeError, RecursionError):
        return False
    return isinstance(value, dict) and (fields is None or fields >= value.keys())


def strict_json(text: str, fields: tuple[str, ...] | None = None) -> Column:
    """One JSON object without duplicate keys at any depth, lone surrogates or fields other than the named.

    Spark's parser refuses most bad texts first; an Arrow-batched function sees what it lets through.
    """
    known = frozenset(fields) if fields is not None else None

    @F.pandas_udf("boolean")
    def checked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: t is not None and strict_object(t, known)).astype(bool)

    return F.when(F.try_parse_json(text).isNotNull(), checked(F.col(text))).otherwise(F.lit(False))


#: The non-empty values that the stored result of an operation must hold (fixed values: JSON paths).
RESULT_PATHS = {"create_queue": ["$.info.name"], "enqueue": ["$.message.id"], "receive": [], "ack": ["$.acked"], "nack": ["$.message.id"], "extend": ["$.delivery.message.id"], "redrive": ["$.result.source.id", "$.result.child.id"]}


def result_shape_valid(operation: str, result: str) -> Column:
    """Whether a stored idempotency result has what its operation returns."""
    out = F.lit(False)
    for name, paths in RESULT_PATHS.items():
        ok = F.try_parse_json(result).isNotNull()
        for path in paths:
            value = F.get_json_object(F.col(result), path)
            ok = ok & ((value == "true") if path == "$.acked" else (F.length(value) > 0))
        out = F.when(F.col(operation) == name, _sure(ok)).otherwise(out)
    return out


def page_limit(limit: int | None, default: int = DEFAULT.default_list_limit, most: int = DEFAULT.list_limit) -> int:
    """The size of a page; raises for one out of bounds."""
    if limit is None or limit == 0:
        return default
    if not 0 < limit <= most:
        raise ValueError("invalid_request: limit is outside configured bounds")
    return limit
