"""geoseries: geo-tagged events -> neighbourhood time series and forecasts, on Spark.

Subpackages: ``functions`` (Column builders), ``operators`` (DataFrame ->
DataFrame operators), ``sources`` (scans and sinks), ``streaming``
(Structured Streaming jobs), ``plans`` (end-to-end flows and the registered
query catalogue).
"""

__version__ = "0.1.0"
