"""Tidemark: time-series analytics for many series at once, on Spark DataFrames.

Every public function takes DataFrames and returns a DataFrame.  A *panel* is a
table with the series key columns, a date ``ds`` and a value ``y``; the key
columns are always named by the ``by`` argument.
"""

from tidemark.functions.columns import parse_date, week_end
from tidemark.operators.additive import additive_components, additive_forecast
from tidemark.operators.arima import best_order, forecast_next, grid_search, walk_forward
from tidemark.operators.calendars import Rule, country_holidays, holiday_calendar
from tidemark.operators.decompose import decompose
from tidemark.operators.describe import describe, group_mean
from tidemark.operators.diagnostics import adf, critical_values, stationarity_report
from tidemark.operators.evaluate import (
    align,
    compare,
    plot_frame,
    predicted_vs_expected,
    score,
    stack,
)
from tidemark.operators.features import fourier, future_frame, hinges, holiday_days, holiday_flags
from tidemark.operators.likelihood import (
    fit_likelihood,
    likelihood_profile,
    walk_forward_likelihood,
)
from tidemark.operators.ordering import rank_values, sort_values
from tidemark.operators.resample import bucket_sums, fill_calendar, means_of_sums, resample
from tidemark.operators.series import (
    date_range,
    drop_missing,
    head,
    slice_end,
    split,
    tail,
    to_series,
)
from tidemark.operators.transforms import difference, exp, integrate, log, rolling
from tidemark.session import configure, ship
from tidemark.sources.nested import first_element, first_of, nest
from tidemark.sources.panels import read_panel, write_panel
from tidemark.sources.readers import literal, parse_json_records, read_csv, read_json, read_lines
from tidemark.sources.writers import scratch_path, write_csv, write_lines

__all__ = [
    "Rule",
    "additive_components",
    "additive_forecast",
    "adf",
    "align",
    "best_order",
    "bucket_sums",
    "compare",
    "configure",
    "country_holidays",
    "critical_values",
    "date_range",
    "decompose",
    "describe",
    "difference",
    "drop_missing",
    "exp",
    "fill_calendar",
    "first_element",
    "first_of",
    "fit_likelihood",
    "forecast_next",
    "fourier",
    "future_frame",
    "grid_search",
    "group_mean",
    "head",
    "hinges",
    "holiday_calendar",
    "holiday_days",
    "holiday_flags",
    "integrate",
    "likelihood_profile",
    "literal",
    "log",
    "means_of_sums",
    "nest",
    "parse_date",
    "parse_json_records",
    "plot_frame",
    "predicted_vs_expected",
    "rank_values",
    "read_csv",
    "read_json",
    "read_lines",
    "read_panel",
    "resample",
    "rolling",
    "score",
    "ship",
    "scratch_path",
    "slice_end",
    "sort_values",
    "split",
    "stack",
    "stationarity_report",
    "tail",
    "to_series",
    "walk_forward",
    "walk_forward_likelihood",
    "week_end",
    "write_csv",
    "write_lines",
    "write_panel",
]
