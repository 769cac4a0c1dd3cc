"""Column-expression helpers (JVM side, codegen friendly)."""

from kairos.functions.calendar import (  # noqa: F401
    calendar_columns, hour_bucket_label, intervention_flag, label_in, parse_local_time,
    season, weekday_label,
)
from kairos.functions.numeric import clamp_below, fill_missing, round_half_even  # noqa: F401
from kairos.functions.text import composite_key, pad_left, substr_range, str_sub  # noqa: F401
from kairos.functions.wind import compass_sector, wind_direction, wind_speed  # noqa: F401
