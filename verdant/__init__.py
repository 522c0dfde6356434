"""verdant: crop water-stress analytics as lazy Spark DataFrame transforms.

Every public transform has the shape ``f(df, *, key="series_id", ts="date", ...)
-> DataFrame``; nothing collects to the driver.  Sub-packages:

* ``functions``  column-expression helpers (null-safe windows, indices, calendar)
* ``sources``    readers for landed payloads, dimension tables, fixture views, sinks
* ``operators``  time-series, quality, soil, pixel, alert, prescription, roll-up, ML jobs
* ``plans``      composed end-to-end jobs (one region pass, national roll-up)
* ``streaming``  incremental ingestion of landed payload files
"""

__version__ = "0.1.0"
