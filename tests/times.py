"""Fixed times that several test modules use."""

import datetime as dt

START = dt.datetime(2024, 1, 6, 10, 0, 0)  # a Saturday
