"""Sources and sinks: delivery records, the partitioned lake, the catalog."""
