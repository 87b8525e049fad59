"""Queries over the state, the log and the history of queues."""
