"""Queue analytics on Spark: state, order, log and replay of durable job queues as DataFrame jobs."""
