"""Fleet-speed analytics on Spark: batch and streaming operators over vehicle GPS reports."""

from fleetspeed.schema import Limits

__all__ = ["Limits"]
