from orderflow.functions.time import (day_start, day_range, on_day, year_range, in_year,
                                      epoch_micros, format_delay, month_start)
from orderflow.functions.stats import round6, share_of_total

__all__ = ["day_start", "day_range", "on_day", "year_range", "in_year", "epoch_micros",
           "format_delay", "month_start", "round6", "share_of_total"]
