"""Every operator as a runnable query over the given tables, with its SQL check where SQL can say it."""
