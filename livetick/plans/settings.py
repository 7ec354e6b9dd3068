"""Parameters the registered queries use on the provided tables.

The event table spans 30 days with a handful of hosts, so the reference clock of
200 ms and 1 minute is scaled to hours and days.
"""

TICK, BASE = "1h", "24h"
DENSE_TICK, DENSE_BASE = "5m", "25h"  # 300 ticks per window
LINE_TICK, LINE_BASE = "1d", "30d"
BUCKET = "1d"
TAIL = "1d"
KEEP = "7d"
VIEW = "5d"
HIGH = 70.0
SIGMA = 1.25
SIGMAS = [0.5, 1.0, 1.25, 1.75, 2.5, 3.5]
PLACES = 2  # decimals of the readings
MIN_SAMPLES = 30
BATCH_ROWS = 100
PART_ROWS = 5  # samples of a slice in one part
SERIES_ROWS = 250  # events of a sub-series a user function sees
ALPHA_REQUESTS, ALPHA_TREND, WARM_UP = 0.25, 0.3, 12
HELD_BACK = 150.0

# The declared hosts in display order; 'error' is left out on purpose and sorts as an unknown host.
HOSTS = ["view", "click", "signup", "purchase"]
ALL_HOSTS = HOSTS + ["error"]
DISABLED = ["signup"]
