"""Column functions shared by the stages."""
