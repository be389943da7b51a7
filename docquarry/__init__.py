"""docquarry: documentation analytics and corpus operators on PySpark."""
