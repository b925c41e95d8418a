"""Phone and e-mail normalisation rules of the registration form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col_of

# Fixed values (must equal the registration form's rules):
#   phone kept characters: digits and '+'
#   local prefix '08' is rewritten to '+628'
#   valid phone after dropping blanks and dashes: ^(\+62|62|0)[0-9]{9,13}$
#   valid e-mail: ^[^\s@]+@[^\s@]+\.[^\s@]+$
PHONE_VALID = r"^(\+62|62|0)[0-9]{9,13}$"
EMAIL_VALID = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def phone_clean(phone) -> Column:
    """Keep digits and '+', then turn a leading '08' into '+628'."""
    kept = F.regexp_replace(col_of(phone), r"[^0-9+]", "")
    return F.when(kept.startswith("08"), F.concat(F.lit("+62"), F.substring(kept, 2, 1 << 30))) \
        .otherwise(kept)


def phone_valid(phone) -> Column:
    """Validity as the form checks it: on the raw input minus blanks/dashes."""
    squeezed = F.regexp_replace(col_of(phone), r"[\s-]", "")
    return F.coalesce(squeezed.rlike(PHONE_VALID), F.lit(False))


def email_clean(email) -> Column:
    return F.lower(F.trim(col_of(email)))


def email_valid(email) -> Column:
    return F.coalesce(col_of(email).rlike(EMAIL_VALID), F.lit(False))
