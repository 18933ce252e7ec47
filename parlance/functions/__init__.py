"""Column functions. None of them needs a session or triggers a job."""
