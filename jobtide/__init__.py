"""jobtide: PySpark jobs for job-search records and résumé / job-description text, for all users at once."""
