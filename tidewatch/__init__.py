"""tidewatch: network-flow analytics and anomaly detection as Spark jobs."""

__version__ = "0.1.0"
