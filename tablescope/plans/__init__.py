"""How jobs are laid out: shared scratch tables, sized joins, the whole analysis."""
