"""marlstone: document analytics and ranked retrieval as PySpark DataFrame jobs."""
