"""Errors raised on the driver, and the configuration that says when. Errors of rows are columns, not exceptions."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

logger = logging.getLogger("orbitfold")


class OrbitError(Exception):
    """Anything that this package raises; what it is about goes along as keywords."""

    def __init__(self, message: str, **about):
        super().__init__(message)
        self.message, self.about = message, about

    def __str__(self) -> str:
        told = ", ".join(f"{k}={v!r}" for k, v in self.about.items())
        return f"{self.message} ({told})" if told else self.message


class InvalidElementsError(OrbitError):
    """Lines or records that are no valid elements."""


class PropagationError(OrbitError):
    """An orbit that cannot be propagated."""


class FilterError(OrbitError):
    """Bounds of a filter that make no sense."""


class CoordinateError(OrbitError):
    """A frame or a place that is not defined."""


class ManeuverError(OrbitError):
    """A burn that cannot be done."""


class SpaceWeatherError(OrbitError):
    """No space weather or Earth orientation for a time."""


class EphemerisError(OrbitError):
    """A message or an ephemeris that cannot be read."""


class LookupFailed(OrbitError):
    """A landed catalog that lacks an object, or cannot be fetched."""


@dataclass(frozen=True)
class EngineConfig:
    """Passed to operators, never a global, as executors would not see one.

    ``strict`` (the default) raises where a default would have to be taken, ``landed`` allows lookups in landed tables.
    """

    strict: bool = True
    landed: bool = True

    def relaxed(self) -> EngineConfig:
        return replace(self, strict=False)


def settle(rows: DataFrame, reason: str, config: EngineConfig, error: type[OrbitError] = InvalidElementsError) -> DataFrame:
    """The rows without a reason. Strict: the first with one raises; relaxed: they are left out, but if none is left it raises.

    An empty table stays empty. Whether there is such a row is asked with a limit of one, not by counting.
    """
    bad, good = rows.where(F.col(reason).isNotNull()), rows.where(F.col(reason).isNull())
    one = bad.select(reason).first()
    if one is not None:
        if config.strict:
            raise error("a record is not valid", reason=one[0])
        if good.limit(1).count() == 0:
            raise error("no record is valid", reason=one[0])
        logger.warning("records that are not valid are left out, such as: %s", one[0])
    return good.drop(reason)
