"""driftlens: a Spark-first engine for return paths, fidelity gaps and corpus work."""
