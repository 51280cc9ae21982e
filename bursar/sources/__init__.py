"""Sources and sinks: declared schemas, conforming scans, versioned writes, snapshots, and the test-data
views that present the generated tables as school tables."""
