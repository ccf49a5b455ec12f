"""ionframe: a PySpark-native analytics engine for annotated fragmentation spectra."""
