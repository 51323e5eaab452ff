"""Inventory, reconciliation and cloning of replicated, sharded collections as Spark jobs."""
