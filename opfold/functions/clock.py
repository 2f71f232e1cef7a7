"""Hybrid logical clocks: ``%016x-%04x`` of milliseconds and a counter, so that
string order is time order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 0xFFFF


def encode(physical: Column, logical: Column) -> Column:
    """A counter beyond ``MOST`` goes over into the milliseconds."""
    n = logical.cast("long")
    return F.concat(F.format_string("%016x", physical.cast("long") + F.shiftright(n, 16)), F.lit("-"), F.format_string("%04x", n % (MOST + 1)))


def physical_of(hlc: Column) -> Column:
    """Milliseconds, null if malformed."""
    return F.when(well_formed(hlc), F.conv(F.substring(hlc, 1, 16), 16, 10).cast("long"))


def logical_of(hlc: Column) -> Column:
    return F.when(well_formed(hlc), F.conv(F.substring(hlc, 18, 4), 16, 10).cast("int"))


def well_formed(hlc: Column) -> Column:
    return hlc.rlike("^[0-9a-fA-F]{16}-[0-9a-fA-F]{4}$")


class Clock:
    """A node's clock on the driver. ``wall`` gives milliseconds."""

    def __init__(self, wall, at: str | None = None):
        self.wall = wall
        self.physical, self.logical = self.parse(at) or (0, 0) if at else (0, 0)

    @staticmethod
    def parse(text: str) -> tuple[int, int] | None:
        a, dash, b = text.partition("-")
        try:
            return (int(a, 16), int(b, 16)) if dash and int(b, 16) <= MOST else None
        except ValueError:
            return None

    def current(self) -> str:
        return f"{self.physical:016x}-{self.logical:04x}"

    def now(self) -> str:
        """The next value: the wall if it is ahead, else one tick more."""
        wall = self.wall()
        if wall > self.physical:
            self.physical, self.logical = wall, 0
        elif self.logical < MOST:
            self.logical += 1
        else:
            self.physical, self.logical = self.physical + 1, 0
        return self.current()

    def observe(self, remote: str) -> None:
        """Never fall behind a remote value; malformed ones are ignored."""
        seen = self.parse(remote)
        if seen and seen > (self.physical, self.logical):
            self.physical, self.logical = seen
