"""Writers that publish whole tables or whole batches."""
