"""Guardrail, information-flow and failure-mining analytics on Spark."""
