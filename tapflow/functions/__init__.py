from tapflow.functions.columns import (divide_by_max, hms, histogram_bin, in_band,
                                      l2_norm, l2_normalise, linear_scale,
                                      operational_date, operational_weekday, parse_date, strip,
                                      tagged, time_text, weekday_numbers, zero_pad)

__all__ = ["divide_by_max", "hms", "histogram_bin", "in_band", "l2_norm", "l2_normalise",
           "linear_scale", "operational_date", "operational_weekday", "parse_date", "strip", "tagged",
           "time_text", "weekday_numbers", "zero_pad"]
