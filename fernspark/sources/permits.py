"""A bucket of permits: how many rows a source may admit, kept over restarts."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass


@dataclass
class Permits:
    """``rate`` permits a second come in, ``burst`` at most are kept; a row takes one. In any span of t seconds at most ``burst + rate * t`` rows are admitted.

    ``end`` is the offset up to which rows have been admitted, ``at`` the time of the last look.
    """

    rate: float
    burst: float
    end: int
    at: float
    held: float

    @classmethod
    def start(cls, rate: float, burst: float | None, end: int, now: float) -> Permits:
        """A full bucket. Without ``burst``, as many as come in a second, and at least one, as else none could be admitted ever."""
        if not (rate > 0 and math.isfinite(rate)):
            raise ValueError("a rate is positive and finite")
        most = max(1.0, rate) if burst is None else burst
        if most < 1:
            raise ValueError("a burst holds at least one row")
        return cls(rate, most, end, now, most)

    def admit(self, available: int, now: float) -> int:
        """The offset up to which rows are admitted now, of those up to ``available``; never less than before. A clock that goes back gives nothing."""
        self.held = min(self.burst, self.held + self.rate * max(0.0, now - self.at))
        self.at = max(self.at, now)
        n = max(0, min(available - self.end, int(self.held)))
        self.held -= n
        self.end += n
        return self.end

    def with_rate(self, rate: float, burst: float | None) -> Permits:
        """The same place and time with another rate, as after a restart with other options; permits held beyond the new burst are gone."""
        new = Permits.start(rate, burst, self.end, self.at)
        new.held = min(self.held, new.burst)
        return new


class Ledger:
    """Keeps a bucket as a file of any file system that pyarrow knows by its address; a write is a whole file, then a rename."""

    def __init__(self, address: str):
        from pyarrow import fs

        self.fs, self.path = (fs.LocalFileSystem(), address) if address.startswith("/") else fs.FileSystem.from_uri(address)

    def load(self) -> Permits | None:
        from pyarrow import fs

        if self.fs.get_file_info(self.path).type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(self.path) as f:
            return Permits(**json.loads(f.read()))

    def save(self, permits: Permits) -> None:
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        aside = f"{self.path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(aside) as f:
            f.write(json.dumps(asdict(permits)).encode())
        self.fs.move(aside, self.path)
