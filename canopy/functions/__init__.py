"""Scalar column functions (JVM-side expressions) and the few Python UDFs."""
