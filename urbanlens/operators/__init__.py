"""DataFrame -> DataFrame operators: cleaning, exploration, dashboard, geo, questions, routes, features, models, history."""
