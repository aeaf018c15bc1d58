"""Readers, sinks and the table views the queries run on."""
