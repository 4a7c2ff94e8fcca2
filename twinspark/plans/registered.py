"""All registered queries over the catalogue, whichever module they are in."""

from twinspark.plans import media, placing, records, reviews
from twinspark.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "media", "placing", "records", "reviews"]
