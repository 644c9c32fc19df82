"""Column-expression building blocks (all JVM-side, codegen friendly)."""

from stratus.functions.calendar import (  # noqa: F401
    SEASON_MONTHS, SEASON_ORDER, calendar_features, day_flag, in_season,
    parse_time, season_of, season_order, season_year, to_event_time, utc_wall_clock,
)
from stratus.functions.numeric import (  # noqa: F401
    deviation, deviation_class, flag, from_scaled, label_bucket, mean_exact, pct,
    pearson_expr, scaled_long, sum_exact,
)
