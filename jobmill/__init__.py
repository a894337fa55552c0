"""jobmill: job-listing ETL and serving queries as Spark DataFrame jobs."""
