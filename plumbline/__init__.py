"""plumbline: code- and corpus-quality measures as ordinary Spark DataFrame jobs."""
