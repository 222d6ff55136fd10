"""Real-time vehicle positions: the wire format decoded in Arrow batches, and a polling source that a restart replays.

The messages are those of the public GTFS-realtime schema; only the fields of a vehicle's position are read, all others are
passed over by their wire type. No generated bindings are needed.
"""

from __future__ import annotations

import struct
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

COLUMNS = "vehicle_id string, trip_id string, route_id string, lat double, lon double, bearing double, speed double, timestamp bigint"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
#: Numbers of the schema's fields.
ENTITY, ENTITY_ID, ENTITY_VEHICLE = 2, 1, 4
VEHICLE_TRIP, VEHICLE_POSITION, VEHICLE_TIMESTAMP, VEHICLE_DESCRIPTOR = 1, 2, 5, 8
TRIP_ID, ROUTE_ID, DESCRIPTOR_ID = 1, 5, 1
LATITUDE, LONGITUDE, BEARING, SPEED = 1, 2, 3, 5


class Malformed(ValueError):
    """A message that ends early or has a wire type that the format doesn't know."""


def varint(data: memoryview, at: int) -> tuple[int, int]:
    """(value, place behind it)."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Malformed(f"number at byte {at}")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (2**64 - 1), at


def fields(data: memoryview) -> dict[int, list]:
    """Values by field number: ints of varints, memoryviews of all others. Groups, long out of use, are malformed."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            if kind == 2:
                size, at = varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise Malformed(f"wire type {kind} at byte {at}")
            if at + size > len(data):
                raise Malformed(f"field at byte {at} is cut")
            value, at = data[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def _message(found: dict[int, list], number: int) -> dict[int, list] | None:
    """An embedded message; one that occurs more than once is merged, as the format says."""
    parts = [p for p in found.get(number, []) if isinstance(p, memoryview)]
    return fields(memoryview(b"".join(parts))) if parts else None


def _text(found: dict[int, list] | None, number: int) -> str | None:
    values = [v for v in (found or {}).get(number, []) if isinstance(v, memoryview)]
    try:
        return bytes(values[-1]).decode() if values else None
    except UnicodeDecodeError as broken:
        raise Malformed("text is no UTF-8") from broken


def _float(found: dict[int, list], number: int) -> float | None:
    values = [v for v in found.get(number, []) if isinstance(v, memoryview) and len(v) == 4]
    return struct.unpack("<f", values[-1])[0] if values else None


def vehicle_positions(payload: bytes | None) -> list[tuple]:
    """Rows of COLUMNS: entities with a vehicle and a position other than 0, 0. A malformed or null payload has none."""
    try:
        out = []
        for entity in fields(memoryview(payload or b"")).get(ENTITY, []):
            if not isinstance(entity, memoryview):
                continue
            found = fields(entity)
            vehicle = _message(found, ENTITY_VEHICLE)
            place = _message(vehicle, VEHICLE_POSITION) if vehicle is not None else None
            if not place:
                continue
            lat, lon = _float(place, LATITUDE) or 0.0, _float(place, LONGITUDE) or 0.0
            if not lat and not lon:
                continue
            trip, who = _message(vehicle, VEHICLE_TRIP), _message(vehicle, VEHICLE_DESCRIPTOR)
            name = (_text(who, DESCRIPTOR_ID) or "") if who is not None else (_text(found, ENTITY_ID) or "?")
            at = [v for v in vehicle.get(VEHICLE_TIMESTAMP, []) if isinstance(v, int)]
            stamp = at[-1] if at else None
            out.append((name, _text(trip, TRIP_ID) or None, _text(trip, ROUTE_ID) or None, lat, lon, _float(place, BEARING), _float(place, SPEED), stamp if stamp is None or stamp < 2**63 else None))
        return out
    except Malformed:
        return []


def decoded(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The other columns of payloads, once for each vehicle position of its message."""
    keep = [c for c in payloads.columns if c != payload]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, index = [], []
            for k, p in enumerate(b.column(payload).to_pylist()):
                found = vehicle_positions(p)
                rows += found
                index += [k] * len(found)
            picked = [b.column(c).take(pa.array(index, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*picked, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS))], [*keep, *_NAMES])

    kept = "".join(f"`{c}` {payloads.schema[c].dataType.simpleString()}, " for c in keep)
    return payloads.mapInArrow(each, kept + COLUMNS)


def _tagged(number: int, value: int | float | str | bytes | None) -> bytes:
    if value is None:
        return b""
    number_of = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number_of(n >> 7)
    if isinstance(value, int):
        return number_of(number << 3) + number_of(value)
    if isinstance(value, float):
        return number_of(number << 3 | 5) + struct.pack("<f", value)
    data = value.encode() if isinstance(value, str) else value
    return number_of(number << 3 | 2) + number_of(len(data)) + data


def encode(rows: list[tuple]) -> bytes:
    """A feed message of rows (entity_id, vehicle_id, trip_id, route_id, lat, lon, bearing, speed, timestamp); nulls are left out."""
    out = _tagged(1, _tagged(1, "2.0"))
    for entity, who, trip, route, lat, lon, bearing, speed, at in rows:
        place = _tagged(LATITUDE, lat) + _tagged(LONGITUDE, lon) + _tagged(BEARING, bearing) + _tagged(SPEED, speed)
        about = _tagged(VEHICLE_TRIP, _tagged(TRIP_ID, trip) + _tagged(ROUTE_ID, route)) if trip is not None or route is not None else b""
        vehicle = about + (_tagged(VEHICLE_POSITION, place) if place else b"") + _tagged(VEHICLE_TIMESTAMP, at)
        vehicle += _tagged(VEHICLE_DESCRIPTOR, _tagged(DESCRIPTOR_ID, who)) if who is not None else b""
        out += _tagged(ENTITY, _tagged(ENTITY_ID, entity) + _tagged(ENTITY_VEHICLE, vehicle))
    return out


def fetch(url: str, key: str | None = None, key_param: str | None = None, timeout: float = 10.0) -> bytes | None:
    """The payload at a URL, None on any failure. A key goes into the headers, or into the query as key_param."""
    if not url:
        return None
    headers = {}
    if key and key_param:
        url += ("&" if "?" in url else "?") + f"{key_param}={key}"
    elif key:
        headers = {"Authorization": key, "api_key": key}
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            return answer.read()
    except (OSError, ValueError):
        return None


class FeedReader(SimpleDataSourceStreamReader):
    """Polls a feed once a batch. A payload is written to the log before its offset is handed out, so a batch that is run
    again reads what the first run read, and a payload that was logged but never planned is read before the next poll."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def _log(self) -> tuple[fs.FileSystem, str]:
        system, folder = fs.FileSystem.from_uri(self.options["log"])
        system.create_dir(folder, recursive=True)
        return system, folder

    def _logged(self, poll: int) -> bytes | None:
        system, folder = self._log()
        path = f"{folder}/{poll}.pb"
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as f:
            return f.read()

    def _put(self, poll: int, payload: bytes) -> None:
        system, folder = self._log()
        with system.open_output_stream(f"{folder}/{poll}.tmp") as f:
            f.write(payload)
        system.move(f"{folder}/{poll}.tmp", f"{folder}/{poll}.pb")

    def _rows(self, poll: int, payload: bytes) -> list[tuple]:
        return [(poll, *r) for r in vehicle_positions(payload)]

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        poll = int(start["poll"])
        payload = self._logged(poll)
        if payload is None:
            payload = fetch(self.options.get("url", ""), self.options.get("key"), self.options.get("keyparam"), float(self.options.get("timeout", "10")))
            if not vehicle_positions(payload) or (poll and payload == self._logged(poll - 1)):
                return iter([]), start  # a failure, an empty poll or the last payload again clears nothing
            self._put(poll, payload)
        return iter(self._rows(poll, payload)), {"poll": poll + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for poll in range(int(start["poll"]), int(end["poll"])):
            yield from self._rows(poll, self._logged(poll))

    def commit(self, end: dict) -> None:
        """Payloads are kept for the log of the last poll only, which the next poll is compared with."""
        system, folder = self._log()
        for info in system.get_file_info(fs.FileSelector(folder)):
            name = info.base_name.removesuffix(".pb")
            if name.isdigit() and int(name) < int(end["poll"]) - 1:
                system.delete_file(info.path)


class VehicleFeed(DataSource):
    """spark.readStream.format("vehicle_feed"), options url, key, keyparam, timeout and log (a URI of a folder that survives
    restarts): poll and COLUMNS of each poll that brings news. The trigger's interval is the polling interval."""

    @classmethod
    def name(cls) -> str:
        return "vehicle_feed"

    def schema(self) -> str:
        return f"poll bigint, {COLUMNS}"

    def simpleStreamReader(self, schema: StructType) -> FeedReader:
        if "log" not in self.options:
            raise ValueError("option log: a folder for the payloads is needed")
        return FeedReader(dict(self.options))
