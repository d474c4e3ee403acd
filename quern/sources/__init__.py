"""Files, tables and partitions."""

from quern.sources.io import checkpoint, read, read_hive, read_table, read_unpivoted, unpivot, write, write_hive
from quern.sources.partitions import Hive, NoPartitions, latest, read_latest, read_latest_per_partition, read_partitions, read_table_partitions

__all__ = ["Hive", "NoPartitions", "checkpoint", "latest", "read", "read_hive", "read_latest", "read_latest_per_partition", "read_partitions", "read_table", "read_table_partitions", "read_unpivoted", "unpivot", "write", "write_hive"]
