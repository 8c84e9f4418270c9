"""Sources and sinks: entity loading with explicit schemas, the test-data mapping, report and snapshot writers."""
