"""Reading tables and page texts, and writing exports."""
