"""Scalar column expressions (all built-in Spark functions, no Python UDFs)."""

from urbanlens.functions.calendar import (  # noqa: F401
    calendar_columns,
    hour_clipped,
    hour_modular,
    parse_date,
    weekday_monday0,
)
from urbanlens.functions.coords import coerce_double, in_city_box, rescale_coordinate  # noqa: F401
from urbanlens.functions.text import (  # noqa: F401
    address_key,
    classify_severity,
    cut_text,
    duration_text,
    encode_sex,
    question_crime,
    search_text,
    translate_crime,
)
