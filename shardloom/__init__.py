"""shardloom: analytics over partitioned property graphs, expressed as Spark DataFrame programs."""

__version__ = "0.1.0"
