"""The operators put together: building a dataset, scoring a run, visual questions.

Each plan is lazy but for a few named stages, which are written to the shared
checkpoint folder because several later steps read them.
"""
